"""The same derivations and the expected result of every registered query, in DuckDB SQL."""

from __future__ import annotations

import re

from coursequarry import fixed_values as fv

from bindings.tables import LABELS, LEVELS, NOW_TEXT, SUFFIXES, TOPIC_LEADS, _SLOTS

NOW = f"TIMESTAMP '{NOW_TEXT}'"


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def pick(values: list, index: str) -> str:
    return f"[{', '.join(q(v) for v in values)}][({index})::BIGINT + 1]"


def any_of(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def rows(table: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in table)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


# --- scalar rules ------------------------------------------------------------------------------------


def open_level(nivel: str) -> str:
    return f"{nivel} IN ({q(fv.ANY_LEVEL)}, {q(fv.ALL_LEVELS)})"


def shown_level(nivel: str) -> str:
    return f"CASE WHEN {nivel} = {q(fv.ANY_LEVEL)} THEN {q(fv.INTERMEDIATE)} ELSE {nivel} END"


def language(label: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.LANGUAGE_CODES.items())
    return f"CASE {label} {whens} ELSE {q(fv.DEFAULT_LANGUAGE)} END"


def level(text: str, nivel: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    return (
        f"CASE WHEN NOT ({open_level(nivel)}) THEN {nivel} "
        f"WHEN {any_of(t, fv.BEGINNER_TERMS)} THEN {q(fv.BEGINNER)} "
        f"WHEN {any_of(t, fv.ADVANCED_TERMS)} THEN {q(fv.ADVANCED)} ELSE {q(fv.INTERMEDIATE)} END"
    )


def category(tema: str) -> str:
    t = f"lower(coalesce({tema}, ''))"
    whens = " ".join(f"WHEN {any_of(t, terms)} THEN {q(n)}" for n, terms in fv.CATEGORY_TERMS)
    return f"CASE {whens} ELSE {q(fv.DEFAULT_CATEGORY)} END"


def platform(url: str) -> str:
    host = f"lower(regexp_extract({url}, {q(fv.NETLOC_PATTERN)}, 1))"
    parts = f"string_split({host}, '.')"
    label = f"CASE WHEN len({parts}) >= 2 THEN {parts}[-2] ELSE {host} END"
    titled = (
        f"array_to_string(list_transform(regexp_extract_all({label}, '\\p{{L}}+|\\P{{L}}+'), "
        "lambda p: upper(left(p, 1)) || lower(substr(p, 2))), '')"
    )
    whens = " ".join(f"WHEN contains({host}, {q(h)}) THEN {q(n)}" for h, n in fv.PLATFORM_HOSTS)
    return f"CASE {whens} WHEN {host} = '' THEN {q(fv.DEFAULT_PLATFORM)} ELSE {titled} END"


def valid(url: str, titulo: str, descripcion: str) -> str:
    t = f"lower(coalesce({url}, '') || coalesce({titulo}, '') || coalesce({descripcion}, ''))"
    return (
        f"(NOT {any_of(t, fv.REJECTED_TERMS)} AND NOT {any_of(f'lower({url})', fv.REJECTED_DOMAINS)} "
        f"AND {any_of(t, fv.ACCEPTED_TERMS)})"
    )


def relevance(titulo: str, descripcion: str, tema: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({tema}), '\\s+'), lambda w: w <> '')"
    return (
        f"coalesce(list_sum(list_transform({words}, lambda w: "
        f"CASE WHEN contains(lower(coalesce({titulo}, '')), w) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + "
        f"CASE WHEN contains(lower(coalesce({descripcion}, '')), w) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
        ")), 0.0::DOUBLE)::DOUBLE"
    )


def confidence(url: str, priority: str) -> str:
    u = f"lower({url})"
    return (
        f"CASE WHEN {priority} THEN CASE WHEN {any_of(u, fv.PRIORITY_BONUS_DOMAINS)} "
        f"THEN least({q(fv.PRIORITY_CONFIDENCE)} + {q(fv.PRIORITY_BONUS)}, {q(fv.PRIORITY_CEILING)}) "
        f"ELSE {q(fv.PRIORITY_CONFIDENCE)} END "
        f"WHEN {any_of(u, fv.GENERAL_BONUS_DOMAINS)} "
        f"THEN least({q(fv.GENERAL_CONFIDENCE)} + {q(fv.GENERAL_BONUS)}, {q(fv.GENERAL_CEILING)}) "
        f"ELSE {q(fv.GENERAL_CONFIDENCE)} END"
    )


def quote_plus(text: str) -> str:
    return f"replace(url_encode({text}), '%20', '+')"


def resource_id(url: str) -> str:
    return f"left(md5({url}), 10)"


def clean_chat(text: str) -> str:
    expr = f"coalesce({text}, '')"
    for pattern in [r"(?s)```.*?```", r"(?sm)^\s*\{.*\}\s*$", r"<[^>]+>", r"(?s)\{.*\}\s*$", r"^\s+|\s+$"]:
        expr = f"regexp_replace({expr}, {q(pattern)}, '', 'g')"
    return expr


def countries(js: str) -> str:
    """Country list as text joined with '|'."""
    ok = f"(CASE WHEN json_valid({js}) THEN {js} END)"
    return (
        f"CASE WHEN {ok} IS NULL THEN '' "
        f"WHEN json_type({ok}) = 'ARRAY' THEN array_to_string(from_json({ok}, '[\"VARCHAR\"]'), '|') "
        f"WHEN json_type({ok}) = 'OBJECT' AND json_type({ok}, '$.paises') = 'ARRAY' "
        f"THEN array_to_string(from_json(json_extract({ok}, '$.paises'), '[\"VARCHAR\"]'), '|') "
        f"ELSE 'global' END"
    )


def request_text(tema: str, nivel: str, extra: list[str]) -> str:
    clean = f"replace(replace(trim({tema}), '\"', ''), ':', '')"
    low = f"lower({nivel})"
    group = (
        f"CASE WHEN NOT ({open_level(nivel)}) THEN '(nivel:' || {low} || ' OR \"' || {low} || "
        f"'\" OR \"nivel ' || {low} || '\")' END"
    )
    parts = [f"'\"' || {clean} || '\"'", *[q(g) for g in fv.REQUEST_GROUPS], group, *[q(e) for e in extra]]
    return f"concat_ws(' ', {', '.join(parts)})"


def percent(confianza: str) -> str:
    return f"round_even({confianza} * 100.0::DOUBLE, 0)::INTEGER::VARCHAR || '%'"


def finite(path: str) -> str:
    """A number written as text, NULL where it is none or not finite."""
    number = f"try_cast(json_extract_string(j, {path}) AS DOUBLE)"
    return f"CASE WHEN isfinite({number}) THEN {number} END"


def score(key: str, default: str) -> str:
    """A score of a readable object: the number, or NULL where it is none."""
    path = f"'$.{key}'"
    return (
        f"CASE WHEN json_type(j, {path}) IS NULL THEN {default} "
        f"WHEN json_type(j, {path}) = 'VARCHAR' THEN {finite(path)} "
        f"WHEN json_type(j, {path}) IN ('DOUBLE', 'BIGINT', 'UBIGINT') "
        f"THEN json_extract_string(j, {path})::DOUBLE END"
    )


def score_error(key: str) -> str:
    path = f"'$.{key}'"
    return (
        f"CASE WHEN json_type(j, {path}) = 'VARCHAR' "
        f"AND {finite(path)} IS NULL "
        f"THEN 'could not convert string to float: ''' || json_extract_string(j, {path}) || '''' "
        f"WHEN json_type(j, {path}) = 'NULL' "
        f"THEN 'float() argument must be a string or a real number, not ''NoneType''' END"
    )


def string_list(key: str) -> str:
    return (
        f"CASE WHEN json_type(j, '$.{key}') = 'ARRAY' "
        f"THEN array_to_string(from_json(json_extract(j, '$.{key}'), '[\"VARCHAR\"]'), '|') ELSE '' END"
    )


_PLATFORM_COLUMNS = (
    "id, nombre, url_base, descripcion, idioma, categoria, nivel, confianza, activa, "
    "tipo_certificacion, validez_internacional, paises_validos, reputacion_academica"
)
_RESULT = (
    "query_id, fuente_orden, pos, id, titulo, url, descripcion, plataforma, idioma, nivel, categoria, "
    "confianza, tipo, fuente, relevancia, prioritario, confianza_db, cert_tipo, cert_paises, cert_costo, "
    "cert_reputacion, cert_valida"
)
_NO_CERT = (
    "NULL::VARCHAR AS cert_tipo, NULL::VARCHAR AS cert_paises, NULL::DOUBLE AS cert_costo, "
    "NULL::DOUBLE AS cert_reputacion, NULL::BOOLEAN AS cert_valida"
)
_NO_META = "NULL::DOUBLE AS relevancia, NULL::BOOLEAN AS prioritario, NULL::DOUBLE AS confianza_db"

# --- building blocks, each a table expression -----------------------------------------------------------

CTE: dict[str, str] = {}

CTE["request_words"] = r"""
SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w
FROM conversations WHERE role = 'user'"""

CTE["request_picks"] = """
SELECT conv_id, turn, arg_max(w, (length(w), w)) AS longest,
       arg_max(w, (length(w), w)) FILTER (WHERE length(w) <= 5) AS short
FROM request_words GROUP BY conv_id, turn"""

CTE["requests"] = f"""
SELECT c.conv_id * 1000 + c.turn AS query_id,
       concat_ws(' ', nullif({pick(TOPIC_LEADS, '(c.conv_id + c.turn) % 6')}, ''), p.short, p.longest,
                 CASE WHEN c.conv_id % 5 = 0 THEN p.short END,
                 CASE WHEN c.conv_id % 7 = 0 THEN '& *~' END) AS tema,
       {pick(LABELS, 'c.conv_id % 6')} AS idioma_ui,
       {pick(LEVELS, '(c.conv_id + c.turn // 2) % 5')} AS nivel
FROM conversations c LEFT JOIN request_picks p USING (conv_id, turn)
WHERE c.role = 'user'"""

CTE["topics"] = f"""
SELECT *, {language('idioma_ui')} AS idioma FROM requests WHERE trim(tema) <> ''"""

CTE["resources"] = rf"""
SELECT page_id,
       CASE WHEN page_id % 7 = 0 THEN replace(url, '.example.', '.edu.example.')
            WHEN page_id % 11 = 0 THEN replace(url, '.example.', '.gov.example.') ELSE url END AS url,
       regexp_extract(html, '<title>([^<]*)</title>', 1) AS titulo,
       trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
            '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'),
            '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))
         || ' ' || {pick(SUFFIXES, 'page_id % 6')} AS descripcion,
       regexp_extract(html, '<html lang="([^"]*)"', 1) AS idioma
FROM pages"""

CTE["hosts"] = """
SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, min(page_id) + 1000 AS id,
       arg_min(regexp_extract(html, '<html lang="([^"]*)"', 1), page_id) AS lang
FROM pages GROUP BY 1"""

CTE["catalogue"] = f"""
{rows(fv.SEED_PLATFORMS, _PLATFORM_COLUMNS)}
UNION ALL
SELECT id, host, 'https://' || host || '/buscar?q={{}}',
       CASE WHEN id % 9 <> 0 THEN 'Cursos de ' || host END,
       CASE WHEN lang = 'fr' THEN 'pt' ELSE lang END, 'General',
       {pick(['Principiante', 'Intermedio', 'Avanzado', 'Todos', None], 'id % 5')},
       CASE WHEN id % 13 = 0 THEN NULL WHEN id % 11 = 0 THEN 0.0::DOUBLE
            ELSE 0.5::DOUBLE + (id % 50) / 100.0::DOUBLE END,
       id % 6 <> 0,
       {pick(['gratuito', 'audit', 'pago', 'none', None], '(id // 2) % 5')},
       id % 2 = 0,
       {pick(['["es"]', '{"paises":["mx","ar"]}', '{}', 'oops', '3', None, '["uk", "us"] x'], 'id % 7')},
       {pick([None, 0.0, 0.7, 0.95], 'id % 4')}
FROM hosts"""

CTE["slots"] = rows(_SLOTS, "ronda, pos, salto")

CTE["items"] = """
SELECT r.query_id, s.ronda, s.pos, p.url AS link,
       CASE WHEN p.page_id % 17 = 0 THEN '' ELSE p.titulo END AS title,
       CASE WHEN p.page_id % 19 <> 0 THEN p.descripcion END AS snippet
FROM requests r CROSS JOIN slots s
JOIN resources p ON p.page_id = ((r.query_id // 1000 * 13 + r.query_id % 1000) * 17 + s.salto * 11)
                               % (SELECT max(page_id) + 1 FROM pages)
WHERE r.query_id % 6 <> 5"""

CTE["fallback_pages"] = """
SELECT r.query_id, CASE WHEN p.page_id % 3 <> 0
                        THEN replace(p.html, 'href="/', 'href="https://site.example/curso/')
                        ELSE replace(p.html, 'href="/', 'href="https://site.example/') END AS html
FROM requests r JOIN pages p
  ON p.page_id = (r.query_id // 1000 * 13 + r.query_id % 1000) % (SELECT max(page_id) + 1 FROM pages)"""

CTE["fallback_links"] = f"""
SELECT query_id, pos::INTEGER AS pos, link FROM (
  SELECT query_id, unnest(range(len(l))) AS pos, unnest(l) AS link
  FROM (SELECT query_id, regexp_extract_all(html, {q(fv.HREF_PATTERN)}, 1)[1:{fv.FALLBACK_LINKS}] AS l
        FROM fallback_pages))"""

# --- candidates ----------------------------------------------------------------------------------------

CTE["hidden_pairs"] = f"""
SELECT t.query_id, t.tema, t.nivel AS pedido, p.*,
       row_number() OVER (PARTITION BY t.query_id ORDER BY p.confianza DESC NULLS LAST, p.id) - 1 AS pos
FROM topics t JOIN catalogue p
  ON p.activa AND p.idioma = t.idioma
 AND ({open_level('t.nivel')} OR p.nivel = t.nivel OR p.nivel = {q(fv.ALL_LEVELS)})"""

_HAS_CERT = "coalesce(tipo_certificacion, 'none') NOT IN ('', 'none')"
CTE["hidden_rows"] = f"""
SELECT query_id, 0 AS fuente_orden, pos::INTEGER AS pos, {resource_id('u')} AS id,
       {q(fv.HIDDEN_MARK)} || nombre || {q(fv.TITLE_DASH)} || tema AS titulo, u AS url,
       coalesce(nullif(descripcion, ''), {q(fv.NO_DESCRIPTION)}) AS descripcion, nombre AS plataforma,
       idioma, CASE WHEN {open_level('pedido')} THEN nivel ELSE pedido END AS nivel,
       {category('tema')} AS categoria,
       CASE WHEN coalesce(confianza, 0) = 0 THEN {q(fv.HIDDEN_DEFAULT_CONFIDENCE)} ELSE confianza END
         AS confianza,
       'oculta' AS tipo, {q(fv.SOURCE_HIDDEN)} AS fuente, NULL::DOUBLE AS relevancia,
       NULL::BOOLEAN AS prioritario, confianza AS confianza_db,
       CASE WHEN {_HAS_CERT} THEN tipo_certificacion END AS cert_tipo,
       CASE WHEN {_HAS_CERT} THEN {countries('paises_validos')} END AS cert_paises,
       CASE WHEN {_HAS_CERT} THEN CASE WHEN tipo_certificacion = 'gratuito' THEN 0.0::DOUBLE
                                       ELSE {q(fv.CERTIFICATE_COST)} END END AS cert_costo,
       CASE WHEN {_HAS_CERT} THEN CASE WHEN coalesce(reputacion_academica, 0) = 0
            THEN {q(fv.CERTIFICATE_DEFAULT_REPUTATION)} ELSE reputacion_academica END END AS cert_reputacion,
       CASE WHEN {_HAS_CERT} THEN validez_internacional END AS cert_valida
FROM (SELECT *, replace(url_base, '{{}}', {quote_plus('tema')}) AS u FROM hidden_pairs
      WHERE pos < {fv.HIDDEN_LIMIT})"""

CTE["valid_items"] = f"""
SELECT i.*, t.tema, t.nivel, t.idioma FROM items i JOIN topics t USING (query_id)
WHERE {valid('link', 'title', 'snippet')}
  AND ((ronda = 1 AND pos < {fv.WEB_FIRST_ROUND_ITEMS}) OR (ronda = 2 AND pos < {fv.WEB_TOTAL_ITEMS}))"""

CTE["budgeted_items"] = f"""
SELECT * FROM (SELECT *, count(*) FILTER (WHERE ronda = 1) OVER (PARTITION BY query_id) AS k1
               FROM valid_items)
WHERE ronda = 1 OR pos < {fv.WEB_TOTAL_ITEMS} - k1"""

CTE["kept_items"] = f"""
SELECT *, {relevance('title', 'snippet', 'tema')} AS relevancia,
       {confidence('link', 'ronda = 1')} AS confianza
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, link ORDER BY ronda, pos) AS vez
      FROM budgeted_items)
WHERE ronda = 1 OR vez = 1"""

CTE["web_rows"] = f"""
SELECT query_id, 1 AS fuente_orden, (puesto - 1)::INTEGER AS pos, {resource_id('link')} AS id,
       coalesce(nullif(title, ''), {q(fv.WEB_TITLE_PREFIX)} || {resource_id('link')}) AS titulo,
       link AS url, coalesce(nullif(snippet, ''), {q(fv.NO_DESCRIPTION)}) AS descripcion,
       {platform('link')} AS plataforma, idioma,
       {level("coalesce(title, '') || ' ' || coalesce(snippet, '')", 'nivel')} AS nivel,
       {category('tema')} AS categoria, confianza, 'verificada' AS tipo, {q(fv.SOURCE_WEB)} AS fuente,
       relevancia, ronda = 1 AS prioritario, NULL::DOUBLE AS confianza_db, {_NO_CERT}
FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY (ronda = 1) DESC, relevancia DESC, confianza DESC, ronda, pos) AS puesto
      FROM kept_items)
WHERE puesto <= {fv.WEB_TOTAL_ITEMS}"""

CTE["templates"] = rows(fv.KNOWN_TEMPLATES, "idioma, pos, nombre, plantilla")

CTE["known_rows"] = f"""
SELECT query_id, 2 AS fuente_orden, pos::INTEGER AS pos, {resource_id('u')} AS id,
       {q(fv.KNOWN_MARK)} || nombre || {q(fv.TITLE_DASH)} || tema AS titulo, u AS url,
       {q(fv.KNOWN_DESCRIPTION_PREFIX)} || nombre AS descripcion, nombre AS plataforma, idioma,
       {shown_level('nivel')} AS nivel, {category('tema')} AS categoria,
       {q(fv.KNOWN_CONFIDENCE)} AS confianza, 'conocida' AS tipo, {q(fv.SOURCE_KNOWN)} AS fuente,
       {_NO_META}, {_NO_CERT}
FROM (SELECT t.*, k.pos, k.nombre, replace(k.plantilla, '{{}}', {quote_plus('t.tema')}) AS u
      FROM topics t JOIN templates k
        ON k.idioma = CASE WHEN t.idioma IN ('es', 'en', 'pt') THEN t.idioma
                           ELSE {q(fv.DEFAULT_TEMPLATE_LANGUAGE)} END
      WHERE k.pos < {fv.KNOWN_LIMIT})"""

CTE["fallback_rows"] = f"""
SELECT query_id, 3 AS fuente_orden, pos, {resource_id('link')} AS id,
       {q(fv.FALLBACK_MARK + fv.FALLBACK_TITLE + fv.TITLE_DASH)} || tema AS titulo, link AS url,
       {q(fv.FALLBACK_DESCRIPTION)} AS descripcion, {platform('link')} AS plataforma, idioma,
       {shown_level('nivel')} AS nivel, {category('tema')} AS categoria,
       {q(fv.FALLBACK_CONFIDENCE)} AS confianza, 'verificada' AS tipo, {q(fv.SOURCE_FALLBACK)} AS fuente,
       {_NO_META}, {_NO_CERT}
FROM fallback_links JOIN topics USING (query_id)
WHERE {valid('link', q(fv.FALLBACK_TITLE), q(fv.FALLBACK_DESCRIPTION))}"""

CTE["candidates"] = f"""
SELECT {_RESULT} FROM hidden_rows UNION ALL SELECT {_RESULT} FROM web_rows
UNION ALL SELECT {_RESULT} FROM known_rows"""


def _deduped(source: str) -> str:
    return f"""
SELECT {_RESULT} FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url
                                                   ORDER BY fuente_orden, pos) AS vez FROM {source})
WHERE vez = 1"""


def _ranked(source: str) -> str:
    return f"""
SELECT *, puesto <= {fv.DEFAULT_MAX_ANALYSIS} AND fuente <> {q(fv.SOURCE_FALLBACK)} AS analisis_pendiente
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confianza DESC, fuente_orden, pos)::INTEGER
        AS puesto FROM {source})
WHERE puesto <= {fv.DEFAULT_MAX_RESULTS}"""


CTE["deduped"] = _deduped("candidates")
CTE["results"] = _ranked("deduped")
CTE["with_fallback"] = f"""
SELECT {_RESULT} FROM web_rows
UNION ALL SELECT {_RESULT} FROM fallback_rows WHERE query_id NOT IN (SELECT query_id FROM web_rows)"""
CTE["with_fallback_deduped"] = _deduped("with_fallback")
CTE["fallback_results"] = _ranked("with_fallback_deduped")

# --- activity ------------------------------------------------------------------------------------------

CTE["ev"] = "SELECT *, json_extract_string(props, '$.k') AS k FROM events"
CTE["search_log"] = f"""
SELECT event_id AS search_id, ts, 'tema ' || k AS tema, {pick(['es', 'en', 'pt'], 'user_id % 3')} AS idioma,
       {pick(LEVELS[:4], 'event_id % 4')} AS nivel, 'Web' AS plataforma_origen,
       (floor(value)::BIGINT % 16)::INTEGER AS veces_mostrado
FROM ev WHERE event_type = 'view'"""
CTE["clicks"] = """
SELECT event_id AS click_id, ts, 'tema ' || k AS tema FROM ev WHERE event_type = 'click'"""
CTE["favorites"] = """
SELECT event_id AS id, left(md5('https://site.example/curso/' || k), 10) AS id_recurso,
       'Curso ' || k AS titulo, 'https://site.example/curso/' || k AS url,
       CASE WHEN event_id % 3 <> 0 THEN 'nota ' || user_id END AS notas, ts AS creado_en
FROM ev WHERE event_type = 'purchase'"""
CTE["feedback"] = """
SELECT event_id AS id FROM ev WHERE event_type = 'error'"""
CTE["session_starts"] = """
SELECT 'sess_' || user_id AS session_id, min(ts) AS started_at FROM ev
WHERE event_type = 'signup' GROUP BY 1"""
CTE["session_ends"] = """
SELECT 'sess_' || user_id AS session_id, ts FROM ev
WHERE event_type = 'purchase'"""
CTE["settings_log"] = """
SELECT event_id AS seq, ts, 'opt_' || (user_id % 20) AS clave,
       CASE WHEN floor(value)::BIGINT % 2 = 1 THEN '1' ELSE '0' END AS valor
FROM ev"""
CTE["cache_requests"] = f"""
SELECT event_id, ts,
       concat_ws('|', (user_id % 10)::VARCHAR, {pick(['es', 'en', 'pt'], 'user_id % 3')},
                 {pick(LEVELS[:4], 'event_id % 4')}) AS clave,
       (floor(value)::BIGINT % 16)::INTEGER AS n_resultados
FROM ev WHERE event_type = 'view'"""
CTE["cache_sequence"] = """
SELECT *, row_number() OVER (PARTITION BY clave ORDER BY ts, event_id) AS rn FROM cache_requests"""
CTE["cache_walk"] = f"""
SELECT event_id, ts, clave, n_resultados, rn, FALSE AS acierto, ts AS guardado, n_resultados AS n_guardado, event_id AS origen
FROM cache_sequence WHERE rn = 1
UNION ALL
SELECT s.event_id, s.ts, s.clave, s.n_resultados, s.rn, h.hit,
       CASE WHEN h.hit THEN w.guardado ELSE s.ts END, CASE WHEN h.hit THEN w.n_guardado ELSE s.n_resultados END,
       CASE WHEN h.hit THEN w.origen ELSE s.event_id END
FROM cache_walk w JOIN cache_sequence s ON s.clave = w.clave AND s.rn = w.rn + 1,
     LATERAL (SELECT w.n_guardado > 0
                     AND s.ts < w.guardado + INTERVAL {fv.CACHE_TTL_SECONDS} SECOND AS hit) h"""

# --- replies and chat --------------------------------------------------------------------------------------

CTE["ai_input"] = f"""
SELECT doc_id // 5 AS query_id, (doc_id % 5 + 1)::INTEGER AS puesto, {resource_id("'https://' || source || '.example.org/' || doc_id")} AS id,
       'https://' || source || '.example.org/' || doc_id AS url,
       CASE WHEN doc_id % 9 <> 0 THEN 'Documento ' || doc_id END AS titulo,
       CASE WHEN doc_id % 10 <> 0 THEN 'Texto de ' || source END AS descripcion,
       0.5::DOUBLE + (doc_id % 50) / 100.0::DOUBLE AS confianza, doc_id % 2 = 1 AS analisis_pendiente
FROM documents"""

_FULL = (
    "'{\"calidad_educativa\": ' || q || ', \"relevancia_usuario\": ' || r || ', \"razones_calidad\": "
    "[\"clara\", \"breve\"], \"recomendacion_personalizada\": \"Vale la pena.\", \"advertencias\": []}'"
)
CTE["ai_replies"] = f"""
SELECT doc_id // 5 AS query_id, {resource_id("'https://' || source || '.example.org/' || doc_id")} AS id,
  unnest(CASE WHEN doc_id % 10 = 3 THEN [shape, '{{"calidad_educativa": 0.5, "relevancia_usuario": 0.5}}']
              ELSE [shape] END) AS respuesta
FROM (SELECT *, CASE doc_id % 12
    WHEN 0 THEN {_FULL}
    WHEN 1 THEN '{{"calidad_educativa": "' || q || '", "relevancia_usuario": "' || r || '"}}'
    WHEN 2 THEN '{{"calidad_educativa": ' || q || ', "advertencias": ["larga"]}}'
    WHEN 3 THEN '{{"calidad_educativa": null, "relevancia_usuario": ' || r || '}}'
    WHEN 4 THEN '{{"calidad_educativa": ' || q || ', oops'
    WHEN 5 THEN '["calidad_educativa", ' || q || ']'
    WHEN 6 THEN 'Claro:' || chr(10) || {_FULL} || chr(10) || 'Suerte.'
    WHEN 7 THEN '{{"calidad_educativa": "alta", "relevancia_usuario": ' || r || '}}'
    WHEN 8 THEN '{{"calidad_educativa": "nan", "relevancia_usuario": ' || r || '}}'
    WHEN 9 THEN '{{"calidad_educativa": "1e300", "relevancia_usuario": ' || r || '}}'
    WHEN 10 THEN '{{"calidad_educativa": ' || q || ', "relevancia_usuario": "-Infinity"}}'
    WHEN 11 THEN '{{"calidad_educativa": "' || repeat('9', 2000) || '", "relevancia_usuario": ' || r || '}}' END AS shape
FROM (SELECT l.doc_id, d.source, (0.25::DOUBLE + quality / 2.0::DOUBLE)::VARCHAR AS q,
             (1.0::DOUBLE - toxic / 2.0::DOUBLE)::VARCHAR AS r
      FROM labels l JOIN documents d USING (doc_id)))"""

CTE["strict_read"] = """
SELECT i.*, a.respuesta, a.query_id IS NOT NULL AS contestada,
       CASE WHEN json_valid(a.respuesta) THEN a.respuesta ELSE '{}' END AS j
FROM ai_input i LEFT JOIN (SELECT query_id, id, max(respuesta) AS respuesta FROM ai_replies GROUP BY ALL) a
  ON a.query_id = i.query_id AND a.id = i.id AND i.analisis_pendiente"""
CTE["strict_scored"] = f"""
SELECT *, {score(fv.REPLY_QUALITY, 'confianza')} AS c, {score(fv.REPLY_RELEVANCE, 'confianza')} AS v,
       CASE WHEN json_type(j) <> 'OBJECT' THEN '''list'' object has no attribute ''get'''
            ELSE coalesce({score_error(fv.REPLY_QUALITY)}, {score_error(fv.REPLY_RELEVANCE)}) END AS err
FROM strict_read"""
CTE["enriched"] = f"""
SELECT query_id, puesto, id, titulo, descripcion, url,
       CASE WHEN contestada AND err IS NULL
            THEN least(greatest(confianza * {q(fv.BLEND_OWN)} + ((c + v) / 2.0::DOUBLE) * {q(fv.BLEND_REPLY)},
                                {q(fv.BLEND_FLOOR)}), {q(fv.BLEND_CEILING)})
            ELSE confianza END AS confianza,
       analisis_pendiente AND NOT contestada AS analisis_pendiente,
       CASE WHEN contestada THEN CASE WHEN err IS NULL THEN c ELSE 0.0::DOUBLE END END AS calidad_ia,
       CASE WHEN contestada THEN CASE WHEN err IS NULL THEN v ELSE 0.0::DOUBLE END END AS relevancia_ia,
       CASE WHEN contestada THEN CASE WHEN err IS NOT NULL THEN {q(fv.STRICT_ERROR_ADVICE)}
            ELSE coalesce(json_extract_string(j, '$.{fv.REPLY_ADVICE}'), {q(fv.STRICT_DEFAULT_ADVICE)}) END END
         AS recomendacion,
       CASE WHEN contestada THEN CASE WHEN err IS NULL THEN {string_list(fv.REPLY_REASONS)} ELSE '' END END
         AS razones,
       CASE WHEN contestada THEN CASE WHEN err IS NULL THEN {string_list(fv.REPLY_WARNINGS)}
            ELSE {q(fv.STRICT_ERROR_PREFIX)} || err END END AS advertencias,
       contestada
FROM strict_scored"""

CTE["search_replies"] = """
SELECT query_id, left(md5(link), 10) AS id,
       max('{"calidad_educativa": 0.' || (pos % 10) || ', "relevancia_usuario": 0.' || (query_id % 10) || '}') AS respuesta
FROM items WHERE (query_id + pos) % 3 <> 0 GROUP BY ALL"""
CTE["search_scored"] = f"""
SELECT r.*, json_extract_string(a.respuesta, '$.{fv.REPLY_QUALITY}')::DOUBLE AS calidad_ia,
       json_extract_string(a.respuesta, '$.{fv.REPLY_RELEVANCE}')::DOUBLE AS relevancia_ia
FROM results r LEFT JOIN search_replies a ON a.query_id = r.query_id AND a.id = r.id AND r.analisis_pendiente"""
CTE["search_enriched"] = f"""
SELECT * EXCLUDE (puesto), row_number() OVER (PARTITION BY query_id ORDER BY nueva DESC, puesto)::INTEGER AS puesto
FROM (SELECT *, CASE WHEN calidad_ia IS NULL THEN confianza
                     ELSE least(greatest(confianza * {q(fv.BLEND_OWN)}
                            + ((calidad_ia + relevancia_ia) / 2.0::DOUBLE) * {q(fv.BLEND_REPLY)},
                            {q(fv.BLEND_FLOOR)}), {q(fv.BLEND_CEILING)}) END AS nueva FROM search_scored)"""

CTE["loose_read"] = r"""
SELECT *, regexp_extract(respuesta, '(?s)\{.*\}', 0) AS bloque,
       CASE WHEN json_valid(regexp_extract(respuesta, '(?s)\{.*\}', 0))
            THEN regexp_extract(respuesta, '(?s)\{.*\}', 0) ELSE '{}' END AS j
FROM ai_replies"""
CTE["loose_scored"] = f"""
SELECT *, {score(fv.REPLY_QUALITY, q(fv.LOOSE_DEFAULT_SCORE))} AS c,
       {score(fv.REPLY_RELEVANCE, q(fv.LOOSE_DEFAULT_SCORE))} AS v,
       CASE WHEN bloque = '' THEN {q(fv.LOOSE_NO_BLOCK)}
            ELSE coalesce({score_error(fv.REPLY_QUALITY)}, {score_error(fv.REPLY_RELEVANCE)}) END AS err
FROM loose_read"""

CTE["messages"] = """
SELECT conv_id, turn, role,
  CASE WHEN turn % 5 = 4 THEN '```x```' || chr(10) || '{"solo": 1}'
       WHEN conv_id % 4 = 0 THEN text || chr(10) || '```json' || chr(10) || '{"a": 1}' || chr(10) || '```' || chr(10)
       WHEN conv_id % 4 = 1 THEN '  {"tipo": "x",' || chr(10) || ' "y": 2}  ' || chr(10) || text
       WHEN conv_id % 4 = 2 THEN '<b>' || text || '</b> <br/>{"z": [1,' || chr(10) || '2]}  '
       ELSE text END AS text
FROM conversations"""


def build(select: str) -> str:
    """The statement with every building block it needs in front."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(CTE[name])

    visit(select)
    blocks = ",\n".join(f"{n} AS ({CTE[n].strip()})" for n in CTE if n in needed)
    recursive = "RECURSIVE " if "cache_walk" in needed else ""
    return f"WITH {recursive}{blocks}\n{select.strip()}" if blocks else select.strip()


_SHOWN = (
    "query_id, pos, id, titulo, url, descripcion, plataforma, idioma, nivel, categoria, confianza, tipo, "
    "fuente, relevancia, prioritario, confianza_db"
)

SELECTS: dict[str, str] = {
    "platforms_active": f"SELECT {_PLATFORM_COLUMNS} FROM catalogue WHERE activa",
    "platform_count": "SELECT count(*) AS plataformas_activas FROM catalogue WHERE activa",
    "known_platforms": f"SELECT {_SHOWN} FROM known_rows",
    "hidden_search": f"SELECT {_SHOWN} FROM hidden_rows",
    "cert_structs": f"""
SELECT query_id, pos, plataforma, cert_tipo, cert_paises, cert_costo, cert_reputacion, cert_valida,
       CASE WHEN cert_tipo IS NULL THEN '' ELSE concat(
         CASE cert_tipo {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.BADGES.items())} END,
         CASE WHEN cert_valida THEN {q(fv.BADGE_INTERNATIONAL)} END) END AS insignias,
       CASE WHEN cert_tipo IS NOT NULL THEN
         '{{"tipo":"' || cert_tipo || '","paises":[' ||
         CASE WHEN cert_paises = '' THEN '' ELSE '"' || replace(cert_paises, '|', '","') || '"' END
         || ']}}' END AS json
FROM hidden_rows""",
    "web_candidates": """
SELECT query_id, ronda, pos, link, title, relevancia, confianza, ronda = 1 AS prioritario FROM kept_items""",
    "web_ranked": f"SELECT {_SHOWN} FROM web_rows",
    "fallback_search": """
SELECT query_id, puesto, id, titulo, url, plataforma, idioma, nivel, confianza, fuente, analisis_pendiente
FROM fallback_results""",
    "dedupe_first": "SELECT query_id, fuente_orden, pos, id, url FROM deduped",
    "multilayer_search": f"SELECT {_SHOWN.replace('pos, ', 'puesto, ')}, analisis_pendiente FROM results",
    "search_enriched": """
SELECT query_id, puesto, id, url, nueva AS confianza, analisis_pendiente AND calidad_ia IS NULL AS analisis_pendiente,
       calidad_ia, relevancia_ia
FROM search_enriched""",
    "ai_pending": "SELECT query_id, puesto, id, url FROM results WHERE analisis_pendiente",
    "search_events": f"""
SELECT query_id AS search_id, {NOW} AS ts, t.tema, t.idioma, t.nivel,
       e.plataforma_origen, e.veces_mostrado
FROM topics t JOIN (SELECT query_id, string_agg(plataforma, ', ' ORDER BY plataforma) AS plataforma_origen,
                           sum(n)::INTEGER AS veces_mostrado
                    FROM (SELECT query_id, plataforma, count(*) AS n FROM results GROUP BY 1, 2)
                    GROUP BY 1) e USING (query_id)""",
    "report_rows": f"""
SELECT titulo AS "Título", url AS "URL", plataforma AS "Plataforma", nivel AS "Nivel", idioma AS "Idioma",
       categoria AS "Categoría", {percent('confianza')} AS "Confianza", tipo AS "Tipo"
FROM results""",
    "csv_roundtrip": f"""
SELECT id, titulo, url, {q(fv.CSV_DESCRIPTION)} AS descripcion, plataforma, idioma,
       coalesce(nivel, 'Intermedio') AS nivel, categoria, confianza, tipo, {NOW} AS ultima_verificacion,
       TRUE AS activo, {q(fv.SOURCE_CSV)} AS fuente
FROM results""",
    "context_digest": f"""
SELECT 'tendencias' AS seccion, NULL::BIGINT AS query_id, pos, tema AS etiqueta, NULL::VARCHAR AS detalle, total AS n
FROM (SELECT tema, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, tema)::INTEGER AS pos
      FROM search_log GROUP BY tema) WHERE pos <= {fv.TOP_N}
UNION ALL
SELECT 'favoritos', NULL, pos, titulo, NULL, total
FROM (SELECT titulo, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, titulo)::INTEGER AS pos
      FROM favorites GROUP BY titulo) WHERE pos <= {fv.TOP_N}
UNION ALL
SELECT 'catalogo', NULL, pos, nombre, categoria, NULL
FROM (SELECT nombre, categoria, row_number() OVER (ORDER BY id)::INTEGER AS pos
      FROM catalogue WHERE activa) WHERE pos <= {fv.DIGEST_PLATFORMS}
UNION ALL
SELECT 'resultados', query_id, puesto, titulo, plataforma, trunc(calidad_ia * 100)::BIGINT
FROM search_enriched WHERE puesto <= {fv.DIGEST_RESULTS}""",
    "topic_search": f"""
SELECT query_id, tema, puesto, page_id, url, titulo, {platform('url')} AS plataforma,
       {level("titulo || ' ' || descripcion", 'nivel')} AS nivel, {category('tema')} AS categoria,
       confianza, relevancia
FROM (SELECT *, row_number() OVER (PARTITION BY query_id
               ORDER BY relevancia DESC, confianza DESC, page_id)::INTEGER AS puesto
      FROM (SELECT t.query_id, t.tema, t.nivel, p.page_id, p.url, p.titulo, p.descripcion,
                   {confidence('p.url', 'FALSE')} AS confianza,
                   {relevance('p.titulo', 'p.descripcion', 't.tema')} AS relevancia
            FROM topics t, (SELECT * FROM resources WHERE {valid('url', 'titulo', 'descripcion')}) p)
      WHERE relevancia > 0)
WHERE puesto <= {fv.WEB_TOTAL_ITEMS}""",
    "request_rows": f"""
SELECT query_id, 1 AS ronda, {request_text('tema', 'nivel', fv.REQUEST_SITES)} AS q,
       {fv.WEB_FIRST_ROUND_ITEMS} AS num, {q(fv.REQUEST_LANGUAGE_PREFIX)} || idioma AS lr FROM topics
UNION ALL
SELECT query_id, 2, {request_text('tema', 'nivel', fv.REQUEST_EXCLUSIONS)},
       ({fv.WEB_TOTAL_ITEMS} - (SELECT count(*) FROM valid_items v WHERE v.query_id = t.query_id AND v.ronda = 1))::INTEGER,
       {q(fv.REQUEST_LANGUAGE_PREFIX)} || idioma FROM topics t
UNION ALL
SELECT query_id, 3, {quote_plus(f"trim(tema || {q(fv.FALLBACK_REQUEST_WORDS)} || CASE WHEN nivel = {q(fv.ANY_LEVEL)} THEN '' ELSE nivel END)")},
       {fv.FALLBACK_LINKS}, NULL FROM topics""",
    "landed_items": """
SELECT page_id AS query_id, pos::INTEGER AS pos,
       CASE WHEN link = '/de' THEN '' ELSE link END AS link,
       CASE WHEN title = 'the' THEN '' ELSE title END AS title, '' AS snippet
FROM (SELECT page_id, unnest(range(len(l))) AS pos, regexp_extract(unnest(l), 'href="([^"]*)"', 1) AS link,
             regexp_extract(unnest(l), '>([^<]*)<', 1) AS title
      FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages))""",
    "html_links": "SELECT query_id, pos, link FROM fallback_links",
    "lang_code": f"SELECT query_id, idioma_ui, {language('idioma_ui')} AS idioma FROM requests",
    "url_ids": f"""
SELECT 'page' AS origen, page_id AS n, {resource_id('url')} AS id FROM pages
UNION ALL
SELECT 'document', query_id, {resource_id('url')} FROM ai_input""",
    "level_tags": f"""
SELECT page_id, pedido, {level("titulo || ' ' || descripcion", 'pedido')} AS nivel
FROM (SELECT *, {pick(LEVELS, 'page_id % 5')} AS pedido FROM resources)""",
    "category_tags": f"""
SELECT query_id, tema, {category('tema')} AS categoria FROM requests
UNION ALL
SELECT doc_id, left(md5(text), 10), {category('text')} FROM documents""",
    "platform_names": f"SELECT page_id, url, {platform('url')} AS plataforma FROM resources",
    "relevance": f"""
SELECT i.query_id, i.ronda, i.pos, {relevance('i.title', 'i.snippet', 't.tema')} AS relevancia
FROM items i JOIN topics t USING (query_id)""",
    "valid_resources": f"SELECT page_id, url, titulo FROM resources WHERE {valid('url', 'titulo', 'descripcion')}",
    "resource_validity": f"""
SELECT doc_id, {valid("'https://' || source || '.example.org/' || doc_id", 'lang', 'text')} AS valida
FROM documents""",
    "chat_clean": f"""
SELECT * FROM (SELECT conv_id, turn, role, {clean_chat('text')} AS text FROM messages
               WHERE role IN ('assistant', 'user')) WHERE text <> ''""",
    "html_strip": f"SELECT page_id, {clean_chat('html')} AS texto FROM pages",
    "ai_enrich": """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY confianza DESC, puesto)::INTEGER AS puesto,
       id, confianza, analisis_pendiente, calidad_ia, relevancia_ia, recomendacion, razones, advertencias
FROM enriched""",
    "result_cards": f"""
SELECT query_id, puesto, id, coalesce(nullif(titulo, ''), {q(fv.REPORT_NO_TITLE)}) AS titulo,
       coalesce(nullif(descripcion, ''), {q(fv.REPORT_NO_DESCRIPTION)}) AS descripcion,
       CASE WHEN contestada THEN {q(fv.STATUS_READY)} WHEN analisis_pendiente THEN {q(fv.STATUS_PENDING)}
            ELSE {q(fv.STATUS_NONE)} END AS estado,
       try_cast(trunc(calidad_ia * 100) AS INTEGER) AS calidad,
       try_cast(trunc(relevancia_ia * 100) AS INTEGER) AS relevancia,
       '' AS insignias, {percent('confianza')} AS confianza, strftime({NOW}, '%d/%m/%Y') AS verificado
FROM enriched""",
    "ai_parse_loose": f"""
SELECT query_id, id, err IS NULL AS valida,
       CASE WHEN err IS NULL THEN c ELSE {q(fv.LOOSE_DEFAULT_SCORE)} END AS calidad_ia,
       CASE WHEN err IS NULL THEN v ELSE {q(fv.LOOSE_DEFAULT_SCORE)} END AS relevancia_ia,
       CASE WHEN err IS NOT NULL THEN {q(fv.LOOSE_ERROR_ADVICE)}
            ELSE coalesce(json_extract_string(j, '$.{fv.REPLY_ADVICE}'), {q(fv.LOOSE_DEFAULT_ADVICE)}) END
         AS recomendacion,
       CASE WHEN err IS NULL THEN {string_list(fv.REPLY_REASONS)} ELSE '' END AS razones,
       CASE WHEN err IS NULL THEN {string_list(fv.REPLY_WARNINGS)} ELSE err END AS advertencias
FROM loose_scored""",
    "top_topics": f"""
SELECT tema, count(*) AS total FROM search_log GROUP BY tema ORDER BY total DESC, tema LIMIT {fv.TOP_N}""",
    "top_favorites": f"""
SELECT titulo, count(*) AS total FROM favorites GROUP BY titulo ORDER BY total DESC, titulo LIMIT {fv.TOP_N}""",
    "admin_counts": """
SELECT (SELECT count(*) FROM search_log) AS busquedas,
       (SELECT count(*) FROM catalogue WHERE activa) AS plataformas_activas,
       (SELECT count(*) FROM favorites) AS favoritos, (SELECT count(*) FROM feedback) AS feedback""",
    "favorites_list": """
SELECT id, id_recurso, titulo, url, notas, creado_en FROM favorites ORDER BY creado_en DESC, id DESC""",
    "settings_latest": """
SELECT clave, arg_max(valor, (ts, seq)) AS valor, arg_max(valor, (ts, seq)) = '1' AS activada
FROM settings_log GROUP BY clave""",
    "session_close": """
SELECT s.session_id, s.started_at, 'web' AS device, min(e.ts) AS ended_at
FROM session_starts s LEFT JOIN session_ends e ON e.session_id = s.session_id AND e.ts >= s.started_at
GROUP BY 1, 2""",
    "click_attribution": """
SELECT s.search_id, s.tema, s.ts, coalesce(c.n, 0) AS veces_clickeado
FROM search_log s LEFT JOIN (
  SELECT l.search_id, count(*) AS n FROM clicks k ASOF JOIN search_log l ON k.tema = l.tema AND k.ts >= l.ts
  GROUP BY 1) c USING (search_id)""",
    "cache_hits": """
SELECT event_id, ts, clave, n_resultados, acierto, CASE WHEN acierto THEN origen END AS respuesta_de FROM cache_walk""",
    "cache_snapshot": f"""
SELECT clave, floor(epoch({NOW} - ts))::BIGINT AS edad_s, n_resultados, NULL::BIGINT AS entradas
FROM (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY ts DESC, event_id DESC) AS r
      FROM cache_walk WHERE NOT acierto) WHERE r = 1
UNION ALL
SELECT NULL, NULL, NULL, count(DISTINCT clave) FROM cache_walk""",
}


def statements() -> dict[str, str]:
    return {name: build(select) for name, select in SELECTS.items()}
