"""Views of the gold tables under the column and table names that existing SQL uses."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

# View -> (table, our column -> column of the view).
VIEWS: Mapping[str, tuple[str, Mapping[str, str]]] = {
    "dim_tipo_transporte": (
        "dim_service",
        {"service_id": "id_tipo_transporte", "service_group": "grupo_tipo_transporte"},
    ),
    "dim_empresa": ("dim_operator", {"operator": "empresa", "operator_id": "id_empresa"}),
    "dim_local": (
        "dim_place",
        {
            "place_id": "id_local",
            "district": "distrito",
            "zone": "zona",
            "service_zone": "zona_servico",
            "region_group": "regiao_agrupada",
        },
    ),
    "dim_distancia": (
        "dim_distance_band",
        {
            "distance_band_id": "id_distancia",
            "distance_band": "faixa_distancia",
            "distance_description": "descricao_distancia",
        },
    ),
    "dim_tempo_horario": (
        "dim_time_band",
        {"time_band_id": "id_faixa_horaria", "time_band": "faixa_horaria"},
    ),
    "dim_status_gorjeta": (
        "dim_tip_status",
        {"tip_status_id": "id_status_gorjeta", "tipped": "teve_gorjeta"},
    ),
    "dim_status_congestionamento": (
        "dim_congestion_status",
        {
            "congestion_status_id": "id_status_congestionamento",
            "congestion_charged": "incide_taxa_cbd",
        },
    ),
    "fato_corrida": (
        "fact_trip",
        {
            "trip_id": "id_corrida",
            "service_id": "id_tipo_transporte",
            "operator_id": "id_empresa",
            "pickup_place_id": "id_local_embarque",
            "dropoff_place_id": "id_local_desembarque",
            "distance_band_id": "id_faixa_distancia",
            "time_band_id": "id_faixa_horaria",
            "tip_status_id": "id_status_gorjeta",
            "congestion_status_id": "id_status_congestionamento",
            "pickup_ts": "datahora_embarque",
            "duration_s": "duracao_segundos",
            "distance_mi": "distancia_percorrida",
            "fare": "valor_justo",
            "tip": "valor_gorjeta",
            "tolls": "valor_pedagio",
            "improvement_fee": "valor_taxa_modernizacao",
            "airport_fee": "valor_taxa_aeroporto",
            "congestion_fee": "valor_taxa_congestionamento",
            "core_zone_fee": "valor_taxa_congestionamento_cbd",
            "fund_fee": "valor_seguro_bfc",
            "other_fees": "valor_demais_taxas",
            "trips": "quantidade_viagem",
            "payment_class": "tipo_pagamento",
            "year_month": "ano_mes",
            "year": "year",
            "month": "month",
        },
    ),
}


def original_views(star: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        view: star[table].select(*(F.col(ours).alias(theirs) for ours, theirs in columns.items()))
        for view, (table, columns) in VIEWS.items()
    }


def register_original_views(star: Mapping[str, DataFrame]) -> None:
    for view, df in original_views(star).items():
        df.createOrReplaceTempView(view)
