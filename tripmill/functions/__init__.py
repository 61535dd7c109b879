from tripmill.functions.expressions import (  # noqa: F401
    MONEY,
    band,
    clean_text,
    digest,
    first_match,
    flag,
    half_up,
    or_zero,
    share,
)
