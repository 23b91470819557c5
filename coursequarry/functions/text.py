"""Text rules as Column expressions: language, ids, level, category, platform, validity, relevance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from coursequarry import fixed_values as fv


def _contains_any(text: Column, terms: list[str]) -> Column:
    """Whether the text holds one of the terms; the split is folded to a constant array."""
    listed = F.split(F.lit("\n".join(terms)), "\n")
    return F.exists(listed, lambda term: F.contains(text, term))


def let(value: Column, body) -> Column:
    """`body(value)` with the value worked out once per row.

    A filter condition has no common-subexpression elimination, so a long text expression named many
    times in it would be evaluated, and its code generated, as many times.
    """
    return F.transform(F.array(value), body)[0]


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def if_empty(c: Column, default: Column | str) -> Column:
    """`c`, or the default where `c` is null or the empty string."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.when(or_empty(c) == "", default).otherwise(c)


def any_level(nivel: Column) -> Column:
    return nivel.isin(fv.ANY_LEVEL, fv.ALL_LEVELS)


def level_or_intermediate(nivel: Column) -> Column:
    return F.when(nivel == fv.ANY_LEVEL, fv.INTERMEDIATE).otherwise(nivel)


def language_code(label: Column) -> Column:
    pairs = "\n".join(f"{name}\t{code}" for name, code in fv.LANGUAGE_CODES.items())
    codes = F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))
    return F.coalesce(F.try_element_at(codes, label), F.lit(fv.DEFAULT_LANGUAGE))


def resource_id(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 10)


def level(text: Column, requested: Column) -> Column:
    found = let(
        F.lower(or_empty(text)),
        lambda t: F.when(_contains_any(t, fv.BEGINNER_TERMS), fv.BEGINNER)
        .when(_contains_any(t, fv.ADVANCED_TERMS), fv.ADVANCED)
        .otherwise(fv.INTERMEDIATE),
    )
    return F.when(any_level(requested), found).otherwise(requested)


def category(tema: Column) -> Column:
    def first_match(t: Column) -> Column:
        expr = F.lit(fv.DEFAULT_CATEGORY)
        for name, terms in reversed(fv.CATEGORY_TERMS):
            expr = F.when(_contains_any(t, terms), name).otherwise(expr)
        return expr

    return let(F.lower(or_empty(tema)), first_match)


def title_case(c: Column) -> Column:
    """Capital first letter in every run of cased letters, lower case for the rest of the run."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def netloc(url: Column) -> Column:
    """Lower-case authority part of an address, '' where there is none, null where it is malformed."""
    cleaned = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    return let(
        F.lower(F.regexp_extract(cleaned, fv.NETLOC_PATTERN, 1)),
        lambda host: F.when(host.contains("[") == host.contains("]"), host),
    )


def platform(url: Column) -> Column:
    return F.coalesce(let(netloc(url), _platform_of_host), F.lit(fv.DEFAULT_PLATFORM))


def _platform_of_host(host: Column) -> Column:
    parts = F.split(host, r"\.")
    second_last = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(host)
    expr = F.when(host == "", fv.DEFAULT_PLATFORM).otherwise(title_case(second_last))
    for needle, name in reversed(fv.PLATFORM_HOSTS):
        expr = F.when(host.contains(needle), name).otherwise(expr)
    return expr


def is_valid_resource(url: Column, titulo: Column, descripcion: Column) -> Column:
    """No commercial term or shut-out domain, and at least one teaching term.

    The three texts are joined without a separator, so a term may span two of them.
    """
    joined = F.lower(F.concat(or_empty(url), or_empty(titulo), or_empty(descripcion)))
    own = let(F.lower(or_empty(url)), lambda u: ~_contains_any(u, fv.REJECTED_DOMAINS))
    return own & let(
        joined,
        lambda t: ~_contains_any(t, fv.REJECTED_TERMS) & _contains_any(t, fv.ACCEPTED_TERMS),
    )


def words(text: Column) -> Column:
    """White-space separated words of the lower-case text, repeats kept."""
    return F.filter(F.split(F.lower(text), fv.WHITESPACE), lambda w: w != "")


def relevance(titulo: Column, descripcion: Column, tema: Column) -> Column:
    """1.0 per topic word found in the title plus 0.5 per topic word found in the description."""
    def total(texts: Column) -> Column:
        return F.aggregate(
            words(tema),
            F.lit(0.0),
            lambda acc, w: acc
            + F.when(texts["titulo"].contains(w), F.lit(1.0)).otherwise(F.lit(0.0))
            + F.when(texts["descripcion"].contains(w), F.lit(0.5)).otherwise(F.lit(0.0)),
        )

    lowered = F.struct(
        F.lower(or_empty(titulo)).alias("titulo"), F.lower(or_empty(descripcion)).alias("descripcion")
    )
    return let(lowered, total)


def domain_confidence(url: Column, priority: Column) -> Column:
    def scored(base: float, domains: list[str], bonus: float, ceiling: float) -> Column:
        raised = F.lit(min(base + bonus, ceiling))
        return F.when(let(F.lower(or_empty(url)), lambda u: _contains_any(u, domains)), raised).otherwise(
            F.lit(base)
        )

    return F.when(
        priority,
        scored(fv.PRIORITY_CONFIDENCE, fv.PRIORITY_BONUS_DOMAINS, fv.PRIORITY_BONUS, fv.PRIORITY_CEILING),
    ).otherwise(
        scored(fv.GENERAL_CONFIDENCE, fv.GENERAL_BONUS_DOMAINS, fv.GENERAL_BONUS, fv.GENERAL_CEILING)
    )


def clean_chat(text: Column) -> Column:
    """Visible text of a chat message: no fenced code, object blocks, tags or trailing objects."""
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), fv.CHAT_PATTERNS, or_empty(text))


def quote_plus(text: Column) -> Column:
    """Form encoding with blanks as '+', '~' left alone and '*' encoded."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def fill_template(template: Column, tema: Column) -> Column:
    """The template with its first '{}' replaced by the encoded topic."""
    at = F.instr(template, "{}")
    return F.when(
        at > 0,
        F.concat(F.substring(template, F.lit(1), at - 1), quote_plus(tema), F.substr(template, at + 2)),
    ).otherwise(template)
