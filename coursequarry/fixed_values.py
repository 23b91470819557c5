"""Values that decide results and therefore may not vary: word lists, tables, texts, patterns, limits.

Everything here is plain data. The rules that use it live next to the operators.
"""

# --- Fixed values: languages and levels -------------------------------------------------------

LANGUAGE_CODES = {
    "Español (es)": "es",
    "Inglés (en)": "en",
    "Portugués (pt)": "pt",
    "es": "es",
    "en": "en",
    "pt": "pt",
}
DEFAULT_LANGUAGE = "es"
DEFAULT_TEMPLATE_LANGUAGE = "en"

ANY_LEVEL = "Cualquiera"
ALL_LEVELS = "Todos"
BEGINNER = "Principiante"
INTERMEDIATE = "Intermedio"
ADVANCED = "Avanzado"

BEGINNER_TERMS = ["principiante", "básico", "beginner", "desde cero", "intro"]
ADVANCED_TERMS = ["avanzado", "advanced", "experto", "expert"]

# --- Fixed values: topic categories, first match wins -----------------------------------------

CATEGORY_TERMS = [
    ("Programación", ["python", "java", "javascript", "web", "code", "programación", "desarrollo"]),
    ("Data Science", ["data", "datos", "ia", "ai", "machine learning", "ciencia de datos"]),
    ("Diseño", ["design", "diseño", "ux", "ui"]),
    ("Negocios", ["marketing", "negocios", "business", "finanzas", "economía"]),
]
DEFAULT_CATEGORY = "General"

# --- Fixed values: platform names by host substring, first match wins --------------------------

PLATFORM_HOSTS = [
    ("youtube", "YouTube"),
    ("coursera", "Coursera"),
    ("udemy", "Udemy"),
    ("edx", "edX"),
    ("khanacademy", "Khan Academy"),
    ("freecodecamp", "freeCodeCamp"),
]
DEFAULT_PLATFORM = "Web"

# --- Fixed values: validity terms ---------------------------------------------------------------

REJECTED_TERMS = [
    "comprar", "buy", "precio", "price", "premium", "paid", "only", "exclusive", "suscripción",
    "subscription", "membership", "register now", "matrícula",
    "biblioteca virtual miguel de cervantes", "aprende con alf",
]
ACCEPTED_TERMS = [
    "curso", "tutorial", "aprender", "learn", "gratis", "free", "class", "education", "educación",
    "certificado", "certificate",
]
REJECTED_DOMAINS = ["cervantesvirtual.com", "aprendeconalf.es"]

# --- Fixed values: scores, limits and texts of the candidate sources ----------------------------

PRIORITY_CONFIDENCE = 0.90
PRIORITY_BONUS_DOMAINS = [".edu", ".gov"]
PRIORITY_BONUS = 0.05
PRIORITY_CEILING = 0.98
GENERAL_CONFIDENCE = 0.80
GENERAL_BONUS_DOMAINS = [".edu", ".org", ".gov"]
GENERAL_BONUS = 0.1
GENERAL_CEILING = 0.92

WEB_FIRST_ROUND_ITEMS = 6
WEB_TOTAL_ITEMS = 10
HIDDEN_LIMIT = 6
KNOWN_LIMIT = 6
FALLBACK_LINKS = 5

KNOWN_CONFIDENCE = 0.85
HIDDEN_DEFAULT_CONFIDENCE = 0.8
FALLBACK_CONFIDENCE = 0.70
CERTIFICATE_COST = 49.99
CERTIFICATE_DEFAULT_REPUTATION = 0.8

KNOWN_MARK = "🎯 "
HIDDEN_MARK = "💎 "
FALLBACK_MARK = "🦆 "
TITLE_DASH = " — "
WEB_TITLE_PREFIX = "Recurso "
KNOWN_DESCRIPTION_PREFIX = "Búsqueda directa en "
NO_DESCRIPTION = "Sin descripción."
FALLBACK_TITLE = "Resultado en DuckDuckGo"
FALLBACK_DESCRIPTION = "Resultado alternativo desde DuckDuckGo (parseo simple)."

SOURCE_HIDDEN = "plataformas_ocultas"
SOURCE_WEB = "google_api"
SOURCE_KNOWN = "plataformas_conocidas"
SOURCE_FALLBACK = "duckduckgo"
SOURCE_CSV = "import_csv"

# --- Fixed values: search options ---------------------------------------------------------------

DEFAULT_MAX_RESULTS = 15
DEFAULT_MAX_ANALYSIS = 5
CACHE_TTL_SECONDS = 12 * 60 * 60
SESSION_DEVICE = "web"

DEFAULT_FEATURES = {
    "enable_google_api": True,
    "enable_known_platforms": True,
    "enable_hidden_platforms": True,
    "enable_groq_analysis": True,
    "enable_chat_ia": True,
    "enable_favorites": True,
    "enable_feedback": True,
    "enable_export_import": True,
    "enable_offline_cache": True,
    "enable_ddg_fallback": False,
    "enable_debug_mode": False,
    "ui_theme": "auto",
    "max_results": 15,
    "max_analysis": 5,
}

# --- Fixed values: known-platform search addresses, {} stands for the encoded topic --------------

KNOWN_TEMPLATES = [
    ("es", 0, "YouTube Educativo", "https://www.youtube.com/results?search_query=curso+gratis+{}"),
    ("es", 1, "Coursera (ES)", "https://www.coursera.org/search?query={}&languages=es&free=true"),
    ("es", 2, "Udemy (Gratis)", "https://www.udemy.com/courses/search/?q={}&price=price-free&lang=es"),
    ("es", 3, "Khan Academy (ES)", "https://es.khanacademy.org/search?page_search_query={}"),
    ("en", 0, "YouTube Education", "https://www.youtube.com/results?search_query=free+course+{}"),
    ("en", 1, "Khan Academy", "https://www.khanacademy.org/search?page_search_query={}"),
    ("en", 2, "Coursera", "https://www.coursera.org/search?query={}&free=true"),
    ("en", 3, "Udemy (Free)", "https://www.udemy.com/courses/search/?q={}&price=price-free&lang=en"),
    ("en", 4, "edX", "https://www.edx.org/search?tab=course&availability=current&price=free&q={}"),
    ("en", 5, "freeCodeCamp", "https://www.freecodecamp.org/news/search/?query={}"),
    ("pt", 0, "YouTube BR", "https://www.youtube.com/results?search_query=curso+gratuito+{}"),
    ("pt", 1, "Coursera (PT)", "https://www.coursera.org/search?query={}&languages=pt&free=true"),
    ("pt", 2, "Udemy (PT)", "https://www.udemy.com/courses/search/?q={}&price=price-free&lang=pt"),
    ("pt", 3, "Khan Academy (PT)", "https://pt.khanacademy.org/search?page_search_query={}"),
]

# --- Fixed values: first rows of the platform catalogue ------------------------------------------
# id, nombre, url_base, descripcion, idioma, categoria, nivel, confianza, activa, tipo_certificacion,
# validez_internacional, paises_validos, reputacion_academica

SEED_PLATFORMS = [
    (1, "Aprende con Alf", "https://aprendeconalf.es/?s={}",
     "Cursos gratuitos de programación, matemáticas y ciencia de datos con ejercicios prácticos",
     "es", "Programación", "Intermedio", 0.85, True, "gratuito", True, '["es"]', 0.90),
    (2, "Coursera", "https://www.coursera.org/search?query={}&free=true",
     "Plataforma líder con cursos universitarios gratuitos (audit mode)",
     "en", "General", "Avanzado", 0.95, True, "audit", True, '["global"]', 0.95),
    (3, "edX", "https://www.edx.org/search?tab=course&availability=current&price=free&q={}",
     "Cursos de Harvard, MIT y otras universidades top (modo audit gratuito)",
     "en", "Académico", "Avanzado", 0.92, True, "audit", True, '["global"]', 0.93),
    (4, "Kaggle Learn", "https://www.kaggle.com/learn/search?q={}",
     "Microcursos prácticos de ciencia de datos con certificados gratuitos",
     "en", "Data Science", "Intermedio", 0.90, True, "gratuito", True, '["global"]', 0.88),
    (5, "freeCodeCamp", "https://www.freecodecamp.org/news/search/?query={}",
     "Certificados gratuitos completos en desarrollo web y ciencia de datos",
     "en", "Programación", "Intermedio", 0.93, True, "gratuito", True, '["global"]', 0.91),
    (6, "PhET Simulations", "https://phet.colorado.edu/en/search?q={}",
     "Simulaciones interactivas de ciencias y matemáticas",
     "en", "Ciencias", "Todos", 0.88, True, "gratuito", True, '["global"]', 0.85),
    (7, "The Programming Historian", "https://programminghistorian.org/en/lessons/?q={}",
     "Tutoriales académicos de programación y humanidades digitales",
     "en", "Programación", "Avanzado", 0.82, True, "gratuito", False, '["uk", "us", "ca"]', 0.80),
    (8, "Domestika (Gratuito)", "https://www.domestika.org/es/search?query={}&free=1",
     "Cursos gratuitos de diseño creativo",
     "es", "Diseño", "Intermedio", 0.83, True, "pago", True, '["es", "mx", "ar", "cl"]', 0.82),
    (9, "Biblioteca Virtual Miguel de Cervantes", "https://www.cervantesvirtual.com/buscar/?q={}",
     "Recursos académicos hispanos",
     "es", "Humanidades", "Avanzado", 0.87, True, "gratuito", True, '["es", "latam", "eu"]', 0.85),
    (10, "OER Commons", "https://www.oercommons.org/search?q={}",
     "Recursos educativos abiertos",
     "en", "General", "Todos", 0.89, True, "gratuito", True, '["global"]', 0.87),
]

# --- Fixed values: web request texts --------------------------------------------------------------

REQUEST_GROUPS = [
    '(curso OR tutorial OR capacitación OR "aprender a")',
    '(gratis OR gratuito OR free OR "sin costo")',
    "(certificado OR certificación OR certificate)",
]
REQUEST_SITES = [
    "site:youtube.com", "site:coursera.org", "site:udemy.com", "site:edx.org",
    "site:freecodecamp.org", "site:khanacademy.org", "site:futurelearn.com", "site:alison.com",
]
REQUEST_EXCLUSIONS = [
    "-comprar", "-buy", "-precio", "-price", "-premium", "-suscripción", "-subscription", "-pago",
    "-paid", "-matrícula", "-register", "-login", "-sign up", "-onlyfans",
]
REQUEST_LANGUAGE_PREFIX = "lang_"
FALLBACK_REQUEST_WORDS = " free course "

# --- Fixed values: model reply keys, defaults and texts -------------------------------------------

REPLY_QUALITY = "calidad_educativa"
REPLY_RELEVANCE = "relevancia_usuario"
REPLY_ADVICE = "recomendacion_personalizada"
REPLY_REASONS = "razones_calidad"
REPLY_WARNINGS = "advertencias"

STRICT_DEFAULT_ADVICE = "Análisis no concluyente."
STRICT_ERROR_ADVICE = "No se pudo completar el análisis IA."
STRICT_ERROR_SCORE = 0.0
STRICT_ERROR_PREFIX = "Error de API: "
DISABLED_ADVICE = "Análisis IA no disponible o deshabilitado."
DISABLED_WARNING = "Análisis IA deshabilitado o no disponible"

LOOSE_DEFAULT_SCORE = 0.8
LOOSE_DEFAULT_ADVICE = "Curso recomendado."
LOOSE_ERROR_ADVICE = "Error temporal en IA."
LOOSE_NO_BLOCK = "No se encontró JSON válido en la respuesta de Groq"
LOOSE_DISABLED_ADVICE = "IA no disponible. Sistema en modo básico."
LOOSE_DISABLED_WARNING = "Groq desactivado o sin clave API"

BLEND_OWN = 0.7
BLEND_REPLY = 0.3
BLEND_FLOOR = 0.5
BLEND_CEILING = 0.98

# --- Fixed values: certificate badges and report texts ---------------------------------------------

BADGES = {
    "gratuito": "✅ Certificado Gratuito",
    "audit": "🎓 Modo Audit",
    "pago": "💰 Certificado de Pago",
}
BADGE_INTERNATIONAL = "🌐 Validez Internacional"
STATUS_READY = "IA listo"
STATUS_PENDING = "IA pendiente"
STATUS_NONE = "Sin IA"
REPORT_NO_DESCRIPTION = "Sin descripción disponible."
REPORT_NO_TITLE = "Recurso Educativo"
REPORT_DATE_FORMAT = "dd/MM/yyyy"

# --- Fixed values: CSV import defaults ---------------------------------------------------------------

CSV_COLUMNS = ["id", "titulo", "url", "plataforma", "nivel", "idioma", "categoria", "confianza", "tipo",
               "verificado"]
CSV_DEFAULTS = {
    "titulo": "Recurso Importado",
    "url": "",
    "plataforma": "Web",
    "idioma": "es",
    "nivel": "Intermedio",
    "categoria": "General",
    "tipo": "verificada",
}
CSV_DEFAULT_CONFIDENCE = 0.8
CSV_DESCRIPTION = "Importado desde CSV"

# --- Fixed values: digest sizes -----------------------------------------------------------------------

TOP_N = 5
DIGEST_PLATFORMS = 10
DIGEST_RESULTS = 7

# --- Fixed values: patterns, in Java regular-expression syntax -----------------------------------------

# White space as str.split() in Python understands it.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
HREF_PATTERN = r'href="(https?://[^"]+)"'
NETLOC_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
LOOSE_BLOCK_PATTERN = r"(?s)\{.*\}"
# Applied one after the other; the last trims.
CHAT_PATTERNS = [
    r"(?s)```.*?```",
    r"(?smdU)^\s*\{.*\}\s*$",
    r"<[^>]+>",
    r"(?sdU)\{.*\}\s*$",
    r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$",
]
