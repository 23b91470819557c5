"""Model replies (JSON text) to typed scores, and the confidence blend."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from coursequarry import fixed_values as fv
from coursequarry.functions.text import let
from coursequarry.schemas import METADATOS_ANALISIS

# Possessive groups: Java matches them in a loop; others of varying width take a stack frame for each digit.
_NUMBER = r"(?i)^\s*+[+-]?(?:\d(?:_?\d)*+(?:\.(?:\d(?:_?\d)*+)?)?|\.\d(?:_?\d)*+)(?:e[+-]?\d(?:_?\d)*+)?\s*+$"
_NOT_FINITE = r"(?i)^\s*+[+-]?(?:nan|inf|infinity)\s*+$"
_EMPTY_LIST = "array<string>"


def strict_json(text: Column) -> Column:
    """The text as a variant, null unless the whole text is exactly one JSON value.

    The JSON reader ignores what follows the first value; only a lone value fits into an array
    as well as into an object.
    """
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(as_item.isNotNull(), F.try_variant_get(as_field, "$.v", "variant"))


def _is(kind: Column, name: str) -> Column:
    return kind.startswith(name)


def _field(obj: Column, key: str) -> Column:
    return F.try_variant_get(obj, f"$.{key}", "variant")


def _type_name(kind: Column) -> Column:
    return (
        F.when(_is(kind, "OBJECT"), "dict")
        .when(_is(kind, "ARRAY"), "list")
        .when(_is(kind, "STRING"), "str")
        .when(_is(kind, "BOOLEAN"), "bool")
        .when(_is(kind, "VOID"), "NoneType")
        .when(_is(kind, "BIGINT"), "int")
        .otherwise("float")
    )


def _quoted(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def text_to_double(text: Column) -> Column:
    """A number written as text, null where it is not one."""
    plain = F.replace(F.trim(text), F.lit("_"), F.lit(""))
    return F.when(text.rlike(_NUMBER), plain.try_cast("double")).when(
        text.rlike(_NOT_FINITE),
        F.when(F.lower(plain).contains("nan"), F.lit(float("nan")))
        .when(plain.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf"))),
    )


def finite_number(text: Column) -> Column:
    """A number written as text; null where it is none, not finite, or too large for a double."""
    number = text_to_double(text)
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def _score(field: Column) -> Column:
    """A present score as double; null stands for 'not a number', which a score that is not finite counts as."""
    kind = F.schema_of_variant(field)
    return (
        F.when(_is(kind, "STRING"), finite_number(F.try_variant_get(field, "$", "string")))
        .when(_is(kind, "BOOLEAN"), F.try_variant_get(field, "$", "boolean").cast("double"))
        .when(~(_is(kind, "OBJECT") | _is(kind, "ARRAY") | _is(kind, "VOID")),
              F.try_variant_get(field, "$", "double"))
    )


def _score_error(field: Column) -> Column:
    """Error text of a present field that is no number, null where it is one."""
    kind = F.schema_of_variant(field)
    text = F.try_variant_get(field, "$", "string")
    return F.when(
        field.isNotNull() & _score(field).isNull(),
        F.when(_is(kind, "STRING"),
               F.concat(F.lit("could not convert string to float: "), _quoted(text))).otherwise(
            F.concat(F.lit("float() argument must be a string or a real number, not '"),
                     _type_name(kind), F.lit("'"))
        ),
    )


def string_list(field: Column) -> Column:
    """A JSON list as array<string>; anything else, or nothing, as the empty list."""
    return F.when(
        _is(F.schema_of_variant(field), "ARRAY"), F.try_variant_get(field, "$", "array<string>")
    ).otherwise(F.lit(None).cast(_EMPTY_LIST))


def _or_empty_list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_EMPTY_LIST))


def _iterable(field: Column) -> Column:
    """What list() makes of a field: items of a list, characters of a text, keys of an object."""
    kind = F.schema_of_variant(field)
    text = F.try_variant_get(field, "$", "string")
    return (
        F.when(field.isNull(), F.array().cast(_EMPTY_LIST))
        .when(_is(kind, "ARRAY"), F.try_variant_get(field, "$", "array<string>"))
        .when(_is(kind, "STRING"), F.filter(F.split(text, ""), lambda ch: ch != ""))
        .when(_is(kind, "OBJECT"), F.map_keys(F.try_variant_get(field, "$", "map<string,variant>")))
    )


def _iterable_error(field: Column) -> Column:
    return F.when(
        _iterable(field).isNull(),
        F.concat(F.lit("'"), _type_name(F.schema_of_variant(field)), F.lit("' object is not iterable")),
    )


def _python_text(field: Column, default: str) -> Column:
    kind = F.schema_of_variant(field)
    text = F.try_variant_get(field, "$", "string")
    return (
        F.when(field.isNull(), default)
        .when(_is(kind, "VOID"), "None")
        .when(_is(kind, "BOOLEAN"), F.initcap(text))
        .otherwise(text)
    )


def _reply(ok: Column, quality: Column, relevance: Column, advice: Column, reasons: Column,
           warnings: Column) -> Column:
    analysis = F.struct(
        quality.alias("calidad_ia"),
        relevance.alias("relevancia_ia"),
        advice.alias("recomendacion_personalizada"),
        reasons.alias("razones_calidad"),
        warnings.alias("advertencias"),
    ).cast(METADATOS_ANALISIS)
    return F.struct(ok.alias("valida"), analysis.alias("analisis"))


def parse_strict(respuesta: Column, confianza: Column) -> Column:
    """Reply that must be JSON alone; missing scores fall back to the row's own confidence.

    Unreadable text counts as an empty object. A readable non-object or a score that is no number
    gives an error row. Result: struct<valida, analisis>.
    """
    return let(_or_empty_object(strict_json(respuesta)), lambda value: _strict(value, confianza))


def _or_empty_object(value: Column) -> Column:
    return F.coalesce(value, F.parse_json(F.lit("{}")))


def _strict(value: Column, confianza: Column) -> Column:
    kind = F.schema_of_variant(value)
    quality, relevance = _field(value, fv.REPLY_QUALITY), _field(value, fv.REPLY_RELEVANCE)
    advice = _field(value, fv.REPLY_ADVICE)
    error = F.coalesce(
        F.when(~_is(kind, "OBJECT"),
               F.concat(F.lit("'"), _type_name(kind), F.lit("' object has no attribute 'get'"))),
        _score_error(quality),
        _score_error(relevance),
    )
    ok = error.isNull()
    own = confianza.cast("double")
    return _reply(
        ok,
        F.when(ok, F.when(quality.isNull(), own).otherwise(_score(quality)))
        .otherwise(F.lit(fv.STRICT_ERROR_SCORE)),
        F.when(ok, F.when(relevance.isNull(), own).otherwise(_score(relevance)))
        .otherwise(F.lit(fv.STRICT_ERROR_SCORE)),
        F.when(~ok, fv.STRICT_ERROR_ADVICE)
        .when(advice.isNull(), fv.STRICT_DEFAULT_ADVICE)
        .otherwise(F.try_variant_get(advice, "$", "string")),
        F.when(ok, _or_empty_list(string_list(_field(value, fv.REPLY_REASONS))))
        .otherwise(F.array().cast(_EMPTY_LIST)),
        F.when(ok, _or_empty_list(string_list(_field(value, fv.REPLY_WARNINGS))))
        .otherwise(F.array(F.concat(F.lit(fv.STRICT_ERROR_PREFIX), error))),
    )


def parse_loose(respuesta: Column) -> Column:
    """Reply that may carry prose around its object; fixed defaults. Result: struct<valida, analisis>."""
    block = F.regexp_extract(F.coalesce(respuesta, F.lit("")), fv.LOOSE_BLOCK_PATTERN, 0)
    return let(
        block,
        lambda b: let(_or_empty_object(strict_json(b)), lambda value: _loose(b, value)),
    )


def _loose(block: Column, value: Column) -> Column:
    quality, relevance = _field(value, fv.REPLY_QUALITY), _field(value, fv.REPLY_RELEVANCE)
    reasons, warnings = _field(value, fv.REPLY_REASONS), _field(value, fv.REPLY_WARNINGS)
    error = F.coalesce(
        F.when(block == "", fv.LOOSE_NO_BLOCK),
        _score_error(quality),
        _score_error(relevance),
        _iterable_error(reasons),
        _iterable_error(warnings),
    )
    ok = error.isNull()
    default = F.lit(fv.LOOSE_DEFAULT_SCORE)
    return _reply(
        ok,
        F.when(ok & quality.isNotNull(), _score(quality)).otherwise(default),
        F.when(ok & relevance.isNotNull(), _score(relevance)).otherwise(default),
        F.when(ok, _python_text(_field(value, fv.REPLY_ADVICE), fv.LOOSE_DEFAULT_ADVICE))
        .otherwise(fv.LOOSE_ERROR_ADVICE),
        F.when(ok, _iterable(reasons)).otherwise(F.array().cast(_EMPTY_LIST)),
        F.when(ok, _iterable(warnings)).otherwise(F.array(error)),
    )


def disabled_strict(confianza: Column) -> Column:
    """What a row gets when scoring is switched off: its own confidence, and a warning."""
    return _reply(F.lit(False), confianza, confianza, F.lit(fv.DISABLED_ADVICE),
                  F.array().cast(_EMPTY_LIST), F.array(F.lit(fv.DISABLED_WARNING)))


def disabled_loose() -> Column:
    default = F.lit(fv.LOOSE_DEFAULT_SCORE)
    return _reply(F.lit(False), default, default, F.lit(fv.LOOSE_DISABLED_ADVICE),
                  F.array().cast(_EMPTY_LIST), F.array(F.lit(fv.LOOSE_DISABLED_WARNING)))


def blend(confianza: Column, quality: Column, relevance: Column) -> Column:
    """Own confidence and mean reply score, weighted and held within the limits."""
    mean = (quality + relevance) / F.lit(2.0)
    mixed = confianza * F.lit(fv.BLEND_OWN) + mean * F.lit(fv.BLEND_REPLY)
    return F.least(F.greatest(mixed, F.lit(fv.BLEND_FLOOR)), F.lit(fv.BLEND_CEILING))
