"""Table layouts, as DDL text. Times are local wall-clock times without a zone."""

from __future__ import annotations

CERTIFICACION = (
    "struct<plataforma:string,curso:string,tipo:string,validez_internacional:boolean,"
    "paises_validos:array<string>,costo_certificado:double,reputacion_academica:double,"
    "ultima_verificacion:timestamp_ntz>"
)
METADATOS = "struct<fuente:string,relevancia:double,prioritario:boolean,confianza_db:double>"
METADATOS_ANALISIS = (
    "struct<calidad_ia:double,relevancia_ia:double,recomendacion_personalizada:string,"
    "razones_calidad:array<string>,advertencias:array<string>>"
)

# A search request as the form sends it.
REQUESTS = "query_id bigint, tema string, idioma_ui string, nivel string"

# One search result. `fuente_orden` is the order of the source, `pos` the place within it.
RESULTS = (
    "query_id bigint, fuente_orden int, pos int, id string, titulo string, url string, descripcion string, "
    "plataforma string, idioma string, nivel string, categoria string, "
    f"certificacion {CERTIFICACION}, confianza double, tipo string, ultima_verificacion timestamp_ntz, "
    f"activo boolean, metadatos {METADATOS}, metadatos_analisis {METADATOS_ANALISIS}, "
    "analisis_pendiente boolean"
)

PLATFORMS = (
    "id bigint, nombre string, url_base string, descripcion string, idioma string, categoria string, "
    "nivel string, confianza double, activa boolean, tipo_certificacion string, "
    "validez_internacional boolean, paises_validos string, reputacion_academica double"
)
KNOWN_TEMPLATES = "idioma string, pos int, nombre string, plantilla string"

# One web reply as landed: items are {link, title, snippet}, in the order the search service gave them.
LANDED_REPLIES = (
    "query_id bigint, ronda int, items array<struct<link:string,title:string,snippet:string>>"
)

SEARCH_LOG = (
    "search_id bigint, ts timestamp_ntz, tema string, idioma string, nivel string, "
    "plataforma_origen string, veces_mostrado int"
)
CLICKS = "click_id bigint, ts timestamp_ntz, tema string"
FAVORITES = (
    "id bigint, id_recurso string, titulo string, url string, notas string, creado_en timestamp_ntz"
)
FEEDBACK = "id bigint, id_recurso string, opinion string, rating int, creado_en timestamp_ntz"
SESSION_STARTS = "session_id string, started_at timestamp_ntz, device string, prefs_json string"
SESSION_ENDS = "session_id string, ts timestamp_ntz"
SETTINGS_LOG = "seq bigint, ts timestamp_ntz, clave string, valor string"
CACHE_REQUESTS = "event_id bigint, ts timestamp_ntz, clave string, n_resultados int"
AI_REPLIES = "query_id bigint, id string, respuesta string"
