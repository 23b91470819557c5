"""Scalar rules against expected values worked out by hand."""

import math
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from coursequarry.functions import labels as lb
from coursequarry.functions import replies as rp
from coursequarry.functions import text as tx


def evaluate(spark, layout, rows, *exprs):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + layout)
    out = df.orderBy("i").select(*[e.alias(f"c{n}") for n, e in enumerate(exprs)]).collect()
    return [r[0] if len(exprs) == 1 else tuple(r) for r in out]


def c(name):
    return F.col(name)


def test_language(spark):
    rows = [("Español (es)",), ("Inglés (en)",), ("Portugués (pt)",), ("es",), ("en",), ("pt",), ("xx",), (None,)]
    assert evaluate(spark, "a string", rows, tx.language_code(c("a"))) == [
        "es", "en", "pt", "es", "en", "pt", "es", "es"]


def test_level(spark):
    cases = [
        (("Curso avanzado", "Cualquiera"), "Avanzado"),
        (("Curso básico", "Cualquiera"), "Principiante"),
        (("Curso intermedio", "Cualquiera"), "Intermedio"),
        (("curso básico", "Avanzado"), "Avanzado"),
        (("curso básico", "Todos"), "Principiante"),
        (("expert intro", "Todos"), "Principiante"),
        ((None, "Cualquiera"), "Intermedio"),
        (("EXPERTO", "Cualquiera"), "Avanzado"),
    ]
    got = evaluate(spark, "t string, n string", [r for r, _ in cases], tx.level(c("t"), c("n")))
    assert got == [want for _, want in cases]


def test_category(spark):
    cases = [("Python para ciencia de datos", "Programación"), ("historia", "Data Science"),
             ("guitarra", "Diseño"), ("finanzas", "Negocios"), ("cocina", "General"), (None, "General")]
    got = evaluate(spark, "t string", [(t,) for t, _ in cases], tx.category(c("t")))
    assert got == [want for _, want in cases]


def test_platform(spark):
    cases = [
        ("https://m.youtube.com/x", "YouTube"), ("https://a.my-site.org/", "My-Site"),
        ("http://localhost:80/", "Localhost:80"), ("example.com/x", "Web"), ("http://[bad/", "Web"),
        ("https://a.co.uk", "Co"), ("https://WWW.EDX.org", "edX"), ("//cdn.udemy.com/a", "Udemy"),
        ("https://es.khanacademy.org", "Khan Academy"), ("", "Web"), (None, "Web"),
        ("https://user@host.example.net/p?q#f", "Example"),
    ]
    got = evaluate(spark, "u string", [(u,) for u, _ in cases], tx.platform(c("u")))
    assert got == [want for _, want in cases]


def test_validity(spark):
    cases = [
        (("http://x", "commonly", "curso"), False),
        (("http://x?price=free", "curso", None), False),
        (("http://x/cur", "so", ""), True),
        (("http://www.cervantesvirtual.com/a", "curso", ""), False),
        (("http://a.edu", "historia", "arte"), False),
        (("http://a.edu", None, "Learn"), True),
    ]
    got = evaluate(spark, "u string, t string, d string", [r for r, _ in cases],
                   tx.is_valid_resource(c("u"), c("t"), c("d")))
    assert got == [want for _, want in cases]


def test_relevance(spark):
    cases = [
        (("Python DATA course", "intro to data", "Python data  python"), 3.5),
        (("a", "b", "   "), 0.0),
        ((None, None, "a"), 0.0),
        (("abc", "abc", "b zz"), 1.5),
    ]
    got = evaluate(spark, "t string, d string, q string", [r for r, _ in cases],
                   tx.relevance(c("t"), c("d"), c("q")))
    assert got == [want for _, want in cases]


def test_confidence(spark):
    cases = [
        (("https://a.edu", True), 0.9500000000000001), (("https://a.org", False), 0.9),
        (("https://a.net", False), 0.8), (("https://a.org", True), 0.9), (("https://A.GOV", False), 0.9),
    ]
    got = evaluate(spark, "u string, p boolean", [r for r, _ in cases], tx.domain_confidence(c("u"), c("p")))
    assert got == [want for _, want in cases]


def test_chat_cleaning(spark):
    cases = [
        ("hola\n```json\n{\"a\": 1}\n```\nadiós", "hola\n\nadiós"),
        ("{\"a\": 1}", ""),
        ("antes\n{\"a\": 1}\nmedio\n{\"b\": 2}\ndespués", "antes\n\ndespués"),
        ("<b>Hola</b> tú {\"z\": [1,\n2]}  ", "Hola tú"),
        ("hola {\"a\": 1} ", "hola"),
        (None, ""), ("", ""), ("  texto  ", "texto"),
    ]
    got = evaluate(spark, "t string", [(t,) for t, _ in cases], tx.clean_chat(c("t")))
    assert got == [want for _, want in cases]


def test_encoding(spark):
    texts = ["C++ & *~_-. ñ", "a/b?c=d", "100%", "日本", ""]
    got = evaluate(spark, "t string", [(t,) for t in texts], tx.quote_plus(c("t")))
    assert got == [quote_plus(t) for t in texts]
    assert got[0] == "C%2B%2B+%26+%2A~_-.+%C3%B1"
    filled = evaluate(spark, "b string, t string", [("https://x/?q={}&z={}", "a b"), ("https://x", "a")],
                      tx.fill_template(c("b"), c("t")))
    assert filled == ["https://x/?q=a+b&z={}", "https://x"]


def test_countries(spark):
    cases = [('["es"]', ["es"]), ("{}", ["global"]), ('{"paises":["mx"]}', ["mx"]), ("3", ["global"]),
             ("oops", []), (None, []), ('["es"] x', []), ("null", ["global"]), ("[]", [])]
    got = evaluate(spark, "j string", [(j,) for j, _ in cases], lb.countries(c("j")))
    assert got == [want for _, want in cases]


ERROR = "Error de API: "
STRICT = [
    ('{"calidad_educativa": 0.75, "relevancia_usuario": 1.0, "razones_calidad": ["a", "b"],'
     ' "recomendacion_personalizada": "Sí.", "advertencias": ["x"]}', (True, 0.75, 1.0, "Sí.", ["a", "b"], ["x"])),
    ('{"calidad_educativa": "0.5", "relevancia_usuario": true}',
     (True, 0.5, 1.0, "Análisis no concluyente.", [], [])),
    ("{}", (True, 0.6, 0.6, "Análisis no concluyente.", [], [])),
    (None, (True, 0.6, 0.6, "Análisis no concluyente.", [], [])),
    ('{"calidad_educativa": 0.9, oops', (True, 0.6, 0.6, "Análisis no concluyente.", [], [])),
    ('{"calidad_educativa": 0.9} extra', (True, 0.6, 0.6, "Análisis no concluyente.", [], [])),
    ('{"calidad_educativa": null}', (False, 0.0, 0.0, "No se pudo completar el análisis IA.", [],
     [ERROR + "float() argument must be a string or a real number, not 'NoneType'"])),
    ('[1, 2]', (False, 0.0, 0.0, "No se pudo completar el análisis IA.", [],
     [ERROR + "'list' object has no attribute 'get'"])),
    ('{"relevancia_usuario": "alta"}', (False, 0.0, 0.0, "No se pudo completar el análisis IA.", [],
     [ERROR + "could not convert string to float: 'alta'"])),
    ('{"razones_calidad": "no lista", "advertencias": [1, "b"]}',
     (True, 0.6, 0.6, "Análisis no concluyente.", [], ["1", "b"])),
]


def test_strict_replies(spark):
    got = evaluate(spark, "r string", [(r,) for r, _ in STRICT], rp.parse_strict(c("r"), F.lit(0.6)))
    assert [(g.valida, *g.analisis) for g in got] == [want for _, want in STRICT]


LOOSE = [
    ('Claro: {"calidad_educativa": 0.7, "razones_calidad": ["a"]} fin',
     (True, 0.7, 0.8, "Curso recomendado.", ["a"], [])),
    ("sin objeto", (False, 0.8, 0.8, "Error temporal en IA.", [],
     ["No se encontró JSON válido en la respuesta de Groq"])),
    (None, (False, 0.8, 0.8, "Error temporal en IA.", [],
     ["No se encontró JSON válido en la respuesta de Groq"])),
    ("{mal}", (True, 0.8, 0.8, "Curso recomendado.", [], [])),
    ('{"calidad_educativa": "x"}', (False, 0.8, 0.8, "Error temporal en IA.", [],
     ["could not convert string to float: 'x'"])),
    ('{"razones_calidad": null}', (False, 0.8, 0.8, "Error temporal en IA.", [],
     ["'NoneType' object is not iterable"])),
    ('{"razones_calidad": "ab", "recomendacion_personalizada": null}',
     (True, 0.8, 0.8, "None", ["a", "b"], [])),
]


def test_loose_replies(spark):
    got = evaluate(spark, "r string", [(r,) for r, _ in LOOSE], rp.parse_loose(c("r")))
    assert [(g.valida, *g.analisis) for g in got] == [want for _, want in LOOSE]


def test_number_text(spark):
    texts = ["1.5", " 2 ", "1_000", "1e3", ".5", "5.", "nan", "-inf", "1f", "0x1", "", "1__0", "+3"]
    got = evaluate(spark, "t string", [(t,) for t in texts], rp.text_to_double(c("t")))
    for text, value in zip(texts, got):
        try:
            want = float(text)
        except ValueError:
            want = None
        assert (value is None) == (want is None), text
        assert value == want or (want is not None and math.isnan(want) and math.isnan(value)), text


def test_blend(spark):
    rows = [(0.9, 1.0, 1.0), (0.1, 0.0, 0.0), (1.0, 1.0, 1.0)]
    got = evaluate(spark, "a double, q double, r double", rows, rp.blend(c("a"), c("q"), c("r")))
    assert got == pytest.approx([0.93, 0.5, 0.98], abs=1e-12)


def test_report_labels(spark):
    rows = [(0.825, 0.999), (0.835, 0.5), (0.85, None)]
    assert evaluate(spark, "a double, s double", rows, lb.confidence_percent(c("a")),
                    lb.score_percent(c("s"))) == [
        (f"{a:.0%}", None if s is None else int(s * 100)) for a, s in rows]


def test_replies_that_hold_odd_numbers(spark):
    from coursequarry.functions import labels as lb, replies as rp

    numbers = ["9" * 100_000, "1_0" * 20_000, "0." + "3" * 100_000, "nan", "Infinity", "-inf", "1e300", "1e999", "7_", "_7",
               " 0.5 ", "1__0", ".5", "5.", "+1e-3", "1e", "", None]
    df = spark.createDataFrame([(i, n, None if n is None else f'{{"calidad_educativa": "{n}", "relevancia_usuario": 1}}')
                                for i, n in enumerate(numbers)], "i int, n string, reply string")
    number = rp.finite_number(F.col("n"))
    got = {r.i: r for r in df.select("i", number.alias("x"), lb.score_percent(number).alias("p"),
                                     lb.confidence_percent(number).alias("c"),
                                     rp.parse_strict(F.col("reply"), F.lit(0.5)).alias("r"),
                                     rp.parse_loose(F.col("reply")).alias("l")).collect()}

    def plain(text):
        try:
            x = float(text)
        except (TypeError, ValueError):
            return None
        return x if abs(x) < float("inf") else None

    for i, n in enumerate(numbers):
        assert got[i].x == plain(n), n and n[:20]
        if n is not None:
            assert got[i].r.valida == got[i].l.valida == (plain(n) is not None)
    assert got[6].p is None and got[6].c is None and got[10].p == 50 and got[10].c == "50%"


def test_percentages_of_numbers_that_are_not_finite(spark):
    from coursequarry.functions import labels as lb

    df = spark.sql("select explode(array(double('nan'), double('inf'), double('-inf'), 1e300D)) as x")
    assert df.select(lb.score_percent(F.col("x")).alias("p"), lb.confidence_percent(F.col("x")).alias("c")).distinct().collect() \
        == [(None, None)]


def test_inputs_use_nearly_all_pages(spark):
    from bindings import tables as b

    sf_dir = "/root/testdata/sf0.01"
    pages = b.read(spark, sf_dir, "pages").count()
    urls = b.web_items(spark, sf_dir).select("link").distinct().count()
    landed = b.fallback_pages(spark, sf_dir).select(F.md5("html")).distinct().count()
    requests = b.requests(spark, sf_dir).count()
    assert urls >= 0.95 * pages
    assert landed >= 0.6 * min(pages, requests)
