"""Certificates, badges and report labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from coursequarry import fixed_values as fv
from coursequarry.functions.replies import strict_json, string_list
from coursequarry.functions.text import if_empty, let
from coursequarry.schemas import CERTIFICACION


def countries(paises_json: Column) -> Column:
    """Country list of a catalogue row; unreadable text gives none, a non-list gives 'global'."""
    return let(strict_json(paises_json), _country_list)


def _country_list(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    inner = F.try_variant_get(value, "$.paises", "variant")
    nothing, everywhere = F.array().cast("array<string>"), F.array(F.lit("global"))
    return (
        F.when(value.isNull(), nothing)
        .when(kind.startswith("ARRAY"), string_list(value))
        .when(kind.startswith("OBJECT") & inner.isNotNull(), F.coalesce(string_list(inner), nothing))
        .otherwise(everywhere)
    )


def certificate(nombre: Column, tema: Column, tipo: Column, validez: Column, paises_json: Column,
                reputacion: Column, now: Column) -> Column:
    built = F.struct(
        nombre.alias("plataforma"),
        tema.alias("curso"),
        tipo.alias("tipo"),
        F.coalesce(validez, F.lit(False)).alias("validez_internacional"),
        countries(paises_json).alias("paises_validos"),
        F.when(tipo == "gratuito", F.lit(0.0)).otherwise(F.lit(fv.CERTIFICATE_COST))
        .alias("costo_certificado"),
        zero_as(reputacion, fv.CERTIFICATE_DEFAULT_REPUTATION).alias("reputacion_academica"),
        now.alias("ultima_verificacion"),
    ).cast(CERTIFICACION)
    return F.when(F.coalesce(tipo, F.lit("none")).isin("", "none"), F.lit(None)).otherwise(built)


def zero_as(c: Column, default: float) -> Column:
    """The number, or the default where it is null or zero."""
    return F.when(F.coalesce(c, F.lit(0.0)) == 0.0, F.lit(default)).otherwise(c)


def badge_labels(cert: Column) -> Column:
    """Badge texts of a certificate, '' for none."""
    tipo = cert["tipo"]
    kind = F.lit(None).cast("string")
    for name, label in fv.BADGES.items():
        kind = F.when(tipo == name, label).otherwise(kind)
    everywhere = F.when(cert["validez_internacional"], fv.BADGE_INTERNATIONAL)
    return F.when(cert.isNull(), "").otherwise(F.concat_ws("", kind, everywhere))


def analysis_status(analysis: Column, pending: Column) -> Column:
    return (
        F.when(analysis.isNotNull(), fv.STATUS_READY)
        .when(pending, fv.STATUS_PENDING)
        .otherwise(fv.STATUS_NONE)
    )


def score_percent(score: Column) -> Column:
    """Whole percent, cut off; null for scores that no percentage shows (not finite, or too large)."""
    return (score * F.lit(100)).try_cast("int")


def confidence_percent(confianza: Column) -> Column:
    """Whole percent as text; exact halves go to the even number. Null where it is not finite or too large."""
    return F.concat(F.bround(confianza * F.lit(100.0), 0).try_cast("int").cast("string"), F.lit("%"))


def shown_title(titulo: Column) -> Column:
    return if_empty(titulo, fv.REPORT_NO_TITLE)


def shown_description(descripcion: Column) -> Column:
    return if_empty(descripcion, fv.REPORT_NO_DESCRIPTION)


def shown_date(ts: Column) -> Column:
    return F.date_format(ts, fv.REPORT_DATE_FORMAT)
