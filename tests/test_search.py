"""Search operators on small tables: limits, order, gates, and results that must not depend on layout."""

import random

import pytest
from pyspark.sql import Window, functions as F

from bindings import tables as b
from coursequarry import fixed_values as fv
from coursequarry import schemas
from coursequarry.operators import activity, candidates as cand, enrich as en, topic_match
from coursequarry.operators.ranking import dedupe_first
from coursequarry.operators.topic_match import best_matches, block_max_best, topic_matches, topic_search
from coursequarry.plans.search import SearchOptions, multilayer_search
from coursequarry.sources import activity_log, catalogue as cat, csv_files, landed
from coursequarry.sources.requests import prepare_topics
from coursequarry.sources.scratch import cut_lineage


def topics_of(spark, rows):
    return prepare_topics(spark.createDataFrame(rows, schemas.REQUESTS))


def test_seed_catalogue(spark, tmp_path):
    seeds = cat.seed_platforms(spark)
    assert seeds.count() == 10
    assert activity.count_active(seeds).first()[0] >= 5
    seeds.limit(0).write.parquet(str(tmp_path / "c"))
    assert cat.read_catalogue(spark, str(tmp_path / "c")).count() == 10
    assert cat.known_templates(spark).groupBy("idioma").count().orderBy("idioma").collect() == [
        ("en", 6), ("es", 4), ("pt", 4)]


def test_unknown_language_uses_english_templates(spark):
    topics = topics_of(spark, [(1, "x", "en", "Todos")]).withColumn("idioma", F.lit("zz"))
    lists = cand.known_lists(topics, cat.known_templates(spark))
    rows = cand.expand(lists, b.now()).orderBy("pos").collect()
    assert [r.plataforma for r in rows] == [t[2] for t in fv.KNOWN_TEMPLATES if t[0] == "en"]
    assert {r.nivel for r in rows} == {"Todos"}


def test_hidden_limit_and_levels(spark):
    topics = topics_of(spark, [(1, "álgebra", "en", "Cualquiera"), (2, "álgebra", "en", "Intermedio"),
                               (3, "álgebra", "en", "Experto"), (4, "  ", "en", "Todos")])
    rows = cand.expand(cand.hidden_lists(topics, cat.seed_platforms(spark)), b.now()).orderBy("query_id", "pos")
    by_query = {}
    for r in rows.collect():
        by_query.setdefault(r.query_id, []).append(r.plataforma)
    assert by_query == {
        1: ["Coursera", "freeCodeCamp", "edX", "Kaggle Learn", "OER Commons", "PhET Simulations"],
        2: ["freeCodeCamp", "Kaggle Learn", "OER Commons", "PhET Simulations"],
        3: ["OER Commons", "PhET Simulations"],
    }


def items_of(spark, rows):
    return spark.createDataFrame(
        rows, "query_id bigint, ronda int, pos int, link string, title string, snippet string")


def test_web_rounds(spark):
    ok = "curso gratis"
    rows = [(1, 1, i, f"http://p{i}.com", ok, None) for i in range(8)]            # two beyond the six
    rows += [(1, 2, i, f"http://q{i}.com", ok, None) for i in range(10)]
    rows[10] = (1, 2, 2, "http://p0.com", ok, None)                               # kept in round one
    rows[1] = (1, 1, 1, "http://p1.com", "precio", None)                          # invalid
    kept = cand.web_kept(topics_of(spark, [(1, "curso", "es", "Todos"), (2, "x", "es", "Todos")]),
                         items_of(spark, rows))
    got = sorted((r.ronda, r.pos) for r in kept.where("ronda IS NOT NULL").collect())
    # five kept in round one leave places 0..4 of round two; place 2 repeats an address
    assert got == [(1, 0), (1, 2), (1, 3), (1, 4), (1, 5), (2, 0), (2, 1), (2, 3), (2, 4)]
    assert {r.query_id for r in kept.collect()} == {1, 2}


def test_first_round_keeps_its_own_repeats_until_dedupe(spark):
    rows = [(1, 1, 0, "http://a.com", "curso", None), (1, 1, 1, "http://a.com", "curso", None)]
    topics = topics_of(spark, [(1, "curso", "es", "Todos")])
    found = cand.expand(cand.web_lists(topics, items_of(spark, rows)), b.now())
    assert found.count() == 2 and dedupe_first(found).collect()[0].pos == 0


def test_gates(spark, sf_dir):
    topics = prepare_topics(b.requests(spark, sf_dir))
    tables = dict(catalogue=b.catalogue(spark, sf_dir), items=b.web_items(spark, sf_dir),
                  fallback_pages=b.fallback_pages(spark, sf_dir))

    def sources(**flags):
        found = multilayer_search(topics, b.now(), options=SearchOptions(**flags), **tables)
        return {r[0] for r in found.select("metadatos.fuente").distinct().collect()}

    assert sources() == {fv.SOURCE_HIDDEN, fv.SOURCE_WEB, fv.SOURCE_KNOWN}
    assert sources(enable_google_api=False, enable_ddg_fallback=True) == {fv.SOURCE_HIDDEN, fv.SOURCE_KNOWN}
    assert sources(enable_known_platforms=False, enable_hidden_platforms=False,
                   enable_ddg_fallback=True) == {fv.SOURCE_WEB, fv.SOURCE_FALLBACK}
    off = multilayer_search(topics, b.now(), options=SearchOptions(enable_groq_analysis=False), **tables)
    assert off.where("analisis_pendiente").isEmpty()


def test_rank_properties(spark, sf_dir):
    topics = prepare_topics(b.requests(spark, sf_dir))
    found = multilayer_search(topics, b.now(), catalogue=b.catalogue(spark, sf_dir),
                              items=b.web_items(spark, sf_dir), options=SearchOptions(max_results=7))
    groups = {}
    for r in found.select("query_id", "puesto", "confianza", "url", "analisis_pendiente").collect():
        groups.setdefault(r.query_id, []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: r.puesto)
        assert [r.puesto for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 7
        assert all(a.confianza >= z.confianza for a, z in zip(rows, rows[1:]))
        assert len({r.url for r in rows}) == len(rows)
        assert [r.analisis_pendiente for r in rows] == [r.puesto <= 5 for r in rows]


def test_layout_does_not_matter(spark, sf_dir):
    topics, items = prepare_topics(b.requests(spark, sf_dir)), b.web_items(spark, sf_dir)
    catalogue = b.catalogue(spark, sf_dir)

    def run(parts):
        found = multilayer_search(topics.repartition(parts), b.now(), catalogue=catalogue.repartition(parts),
                                  items=items.repartition(parts))
        return sorted((r.query_id, r.puesto, r.id) for r in found.collect())

    assert run(1) == run(7)


def test_same_without_broadcast(spark, sf_dir):
    """The way taken when a side is too large to broadcast gives the same rows."""
    topics, catalogue = prepare_topics(b.requests(spark, sf_dir)), b.catalogue(spark, sf_dir)
    resources = b.resources(spark, sf_dir)

    def run():
        hidden = cand.expand(cand.hidden_lists(topics, catalogue), b.now())
        best = topic_search(topics, resources)
        return (sorted((r.query_id, r.pos, r.id) for r in hidden.collect()),
                sorted((r.query_id, r.puesto, r.page_id) for r in best.collect()))

    small = run()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_search_plan_has_two_exchanges_on_topics(spark, sf_dir):
    """Topics and items meet on query_id; nothing after that is shuffled again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        topics = prepare_topics(b.requests(spark, sf_dir))
        items = items_of(spark, [(1, 1, 0, "http://a.com", "curso", None)])
        found = multilayer_search(topics, b.now(), catalogue=cat.seed_platforms(spark), items=items)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange hashpartitioning(query_id" in line for line in plan.splitlines()) == 2
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def brute_matches(topics, resources):
    out = {}
    for tema in topics:
        for page, title, text in resources:
            score = sum((w in title.lower()) * 1.0 + (w in text.lower()) * 0.5 for w in tema.lower().split())
            if score > 0:
                out[(tema, page)] = score
    return out


def test_topic_matches_equal_brute_force(spark):
    rnd = random.Random(5)
    syllables = ["a", "pi", "thon", "da", "ta", "ñu", "ß", "el", "x1", "de"]

    def word():
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))

    texts = [(i, " ".join(word() for _ in range(rnd.randint(0, 3))).title(),
              " ".join(" ".join(word() for _ in range(rnd.randint(0, 6))) for _ in range(2)))
             for i in range(60)]
    # One topic holds a third of the requests; words repeat, and some have one or two letters.
    temas = ["da ta da"] + [" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(14)] + ["a", "ñu"]
    requests = [(i, temas[0] if i % 3 == 0 else temas[i % len(temas)], "es", "Todos") for i in range(60)]
    topics = topics_of(spark, requests)
    pages = spark.createDataFrame(texts, "page_id bigint, titulo string, descripcion string").withColumn(
        "confianza", F.lit(0.8))
    got = {(r.tema, r.page_id): r.relevancia for r in topic_matches(topics, pages).collect()}
    want = brute_matches(sorted({t for _, t, _, _ in requests}), texts)
    assert got == want
    for common in (0, 3, 1000):
        best = {(r.tema, r.puesto): (r.page_id, r.relevancia) for r in best_matches(topics, pages, 4, common).collect()}
        expected = {}
        for tema in {t for t, _ in want}:
            own = sorted(((-s, p) for (t, p), s in want.items() if t == tema))[:4]
            expected |= {(tema, k + 1): (p, -s) for k, (s, p) in enumerate(own)}
        assert best == expected
    for block, limit in ((1, 4), (2, 1), (7, 4), (64, 10), (1000, 3)):
        best = {(r.tema, r.puesto): (r.page_id, r.relevancia)
                for r in block_max_best(topics, pages, limit, block).collect()}
        expected = {}
        for tema in {t for t, _ in want}:
            own = sorted(((-s, p) for (t, p), s in want.items() if t == tema))[:limit]
            expected |= {(tema, k + 1): (p, -s) for k, (s, p) in enumerate(own)}
        assert best == expected, (block, limit)


def test_best_pages_over_many_shards(spark, monkeypatch):
    """Shards, groups and stripes of every size give the best pages of all pairs: ties, hot words, many repeats, no confidence."""
    rng = random.Random(11)
    words = [f"{a}{c}" for a in "abcde" for c in "xyz"] + ["de", "curso"]
    pages = spark.createDataFrame(
        [(3 * i - 40, " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=6)) + " de", rng.choice([0.8, 0.9, None]))
         for i in range(120)], "page_id bigint, titulo string, descripcion string, confianza double")
    topics = topics_of(spark, [(i, " ".join(rng.choices(words, k=rng.randint(1, 5))), "es", "Todos") for i in range(60)] + [
        (70, "de " * 300 + "ax", "es", "Todos"), (71, "nada", "es", "Todos"), (72, "de", "es", "Todos")])
    order = Window.partitionBy("tema").orderBy(F.col("relevancia").desc(), F.col("confianza").desc(), "page_id")
    every = topic_matches(topics, pages).withColumn("puesto", F.row_number().over(order)).where("puesto <= 6")
    columns = ["tema", "puesto", "page_id", "relevancia", "confianza"]
    want = sorted(map(tuple, every.select(columns).collect()))
    assert len(want) > 300
    for postings, group, stripes in ((10**6, 10**6, 4), (90, 20, 1), (90, 7, 3), (30, 1000, 2)):
        monkeypatch.setattr(topic_match, "SHARD_POSTINGS", postings)
        monkeypatch.setattr(topic_match, "GROUP_TOPICS", group)
        monkeypatch.setattr(topic_match, "STRIPES", stripes)
        got = block_max_best(topics, pages, 6).select(columns).collect()
        assert sorted(map(tuple, got)) == want, (postings, group, stripes)


def test_best_pages_write_no_row_per_topic_and_block(spark, monkeypatch):
    written = []

    def counted(df, name="paso"):
        out = cut_lineage(df, name)
        written.append((name, out.count()))
        return out

    pages = spark.createDataFrame([(i, "curso", f"de w{i}") for i in range(400)], "page_id bigint, titulo string, descripcion string")
    topics = topics_of(spark, [(i, f"curso de w{i}", "es", "Todos") for i in range(200)])
    monkeypatch.setattr(topic_match, "cut_lineage", counted)
    best = block_max_best(topics, pages.withColumn("confianza", F.lit(0.8)), 10).collect()
    assert len(best) == 2000 and {(r.tema, r.page_id) for r in best if r.puesto == 1} == {(f"curso de w{i}", i) for i in range(200)}
    # 200 topics times 100 blocks of four pages would be 20,000 rows.
    assert max(n for _, n in written) < 5_000, written


def test_topic_search_answers_every_request(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.edu/1", "Curso de álgebra", "gratis"), (2, "http://b.com", "Álgebra", "curso avanzado"),
         (3, "http://c.com", "Álgebra", "precio")],
        "page_id bigint, url string, titulo string, descripcion string")
    topics = topics_of(spark, [(1, "álgebra", "es", "Todos"), (2, "álgebra", "es", "Principiante"),
                               (3, "nada", "es", "Todos")])
    got = sorted((r.query_id, r.puesto, r.page_id, r.nivel) for r in topic_search(topics, pages).collect())
    assert got == [(1, 1, 1, "Intermedio"), (1, 2, 2, "Avanzado"), (2, 1, 1, "Principiante"),
                   (2, 2, 2, "Principiante")]


def test_enrich_leaves_other_rows_alone(spark, sf_dir):
    results, replies = b.ai_input(spark, sf_dir), b.ai_replies(spark, sf_dir)
    assert en.enrich(results, replies, enabled=False).collect() == results.collect()
    out = en.enrich(results, replies)
    assert out.columns == results.columns and out.count() == results.count()
    assert out.where("NOT analisis_pendiente AND metadatos_analisis IS NULL AND (query_id * 5 + puesto - 1) % 2 = 1").isEmpty()
    assert out.where("metadatos_analisis IS NOT NULL AND (confianza < 0.5 OR confianza > 0.99)").isEmpty()


def test_scorer_is_asked_for_waiting_rows(spark):
    topics = topics_of(spark, [(1, "álgebra", "es", "Todos")])
    found = multilayer_search(topics, b.now(), catalogue=cat.seed_platforms(spark),
                              options=SearchOptions(max_analysis=2))

    def scorer(batches):
        for pdf in batches:
            yield pdf[["query_id", "id"]].assign(respuesta='{"calidad_educativa": 0, "relevancia_usuario": 0}')

    replies = en.replies_from(found, scorer)
    assert replies.count() == 2
    out = en.enrich_and_rerank(found, replies).orderBy("puesto").collect()
    assert [r.puesto for r in out] == list(range(1, len(out) + 1))
    scored = [r for r in out if r.metadatos_analisis]
    # Both lose a share of their confidence and fall behind the rows that were not scored.
    assert [r.puesto for r in scored] == [len(out) - 1, len(out)]
    assert not any(r.analisis_pendiente for r in out)


def test_csv_keeps_ten_columns_and_fills_defaults(spark, tmp_path):
    line = ("r1", 'Di "hola", tú\nsí', "http://a.com/x", " Web ", None, "es", "General", 0.825, "oculta")
    row = spark.createDataFrame(
        [line], "id string, titulo string, url string, plataforma string, nivel string, idioma string, "
                "categoria string, confianza double, tipo string"
    ).withColumn("ultima_verificacion", b.now())
    csv_files.export_results(row, str(tmp_path / "full"))
    back = csv_files.import_results(spark, str(tmp_path / "full"), b.now()).collect()[0]
    assert (back.id, back.titulo, back.url, back.plataforma) == line[:4]
    assert (back.nivel, back.confianza, back.tipo) == ("Intermedio", 0.825, "oculta")
    assert back.metadatos.fuente == fv.SOURCE_CSV and back.certificacion is None

    part = spark.createDataFrame([("http://b.com", "abc")], "url string, confianza string")
    part.write.option("header", True).csv(str(tmp_path / "part"))
    back = csv_files.import_results(spark, str(tmp_path / "part"), b.now()).collect()[0]
    assert (back.titulo, back.plataforma, back.confianza) == ("Recurso Importado", "Web", 0.8)
    assert len(back.id) == 10


def test_landed_replies_from_json(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"query_id": 1, "ronda": 2, "items": [{"link": "u", "title": "t"}, {"snippet": "s"}]}\n'
        '{"query_id": 2, "ronda": 1}\n')
    rows = landed.landed_items(landed.read_replies(spark, str(tmp_path / "r.json"))).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 0, "u", "t", ""), (1, 2, 1, "", "", "s")]


def test_activity_tables(spark, sf_dir, tmp_path):
    log = b.search_log(spark, sf_dir)
    path = str(tmp_path / "log")
    log.write.parquet(path)
    activity_log.clear_search_log(spark, path)
    again = activity_log.read_table(spark, path, schemas.SEARCH_LOG)
    assert again.count() == 0 and again.columns == log.columns

    favorites = b.favorites(spark, sf_dir)
    for _ in range(2):
        activity_log.append_favorites(favorites, str(tmp_path / "fav"))
    stored = activity_log.read_table(spark, str(tmp_path / "fav"), schemas.FAVORITES)
    assert stored.count() == 2 * favorites.count() and stored.where("notas IS NULL").isEmpty()

    activity_log.append_sessions(b.session_starts(spark, sf_dir), str(tmp_path / "ses"), {"max_results": 9})
    prefs = activity_log.read_table(spark, str(tmp_path / "ses"), schemas.SESSION_STARTS).first()
    assert prefs.device == "web" and '"max_results":9' in prefs.prefs_json

    settings = b.settings_log(spark, sf_dir)
    assert activity.flag_is_on(settings, "never written").first()[0] is False


def test_click_credit_with_one_hot_topic(spark):
    from datetime import datetime, timedelta
    rnd = random.Random(3)
    t0 = datetime(2024, 5, 1)
    searches, clicks = [], []
    for i in range(400):
        tema = "hot" if i % 2 else f"t{i % 5}"
        ts = t0 + timedelta(minutes=rnd.randrange(0, 3000, 7))
        (searches if rnd.random() < 0.3 else clicks).append((i, ts, tema))
    log = spark.createDataFrame([(i, ts, tema, "es", "Todos", "Web", 1) for i, ts, tema in searches],
                                schemas.SEARCH_LOG)
    click_rows = spark.createDataFrame(clicks, schemas.CLICKS)
    want = {}
    for i, ts, tema in clicks:
        before = [(s_ts, s) for s, s_ts, s_tema in searches if s_tema == tema and s_ts <= ts]
        if before:
            want[i] = max(before)[1]
    for slot in ("10 minutes", "1 day"):
        got = {r.click_id: r.search_id for r in activity.clicks_to_searches(log, click_rows, slot).collect()}
        assert got == want
    credited = activity.click_attribution(log, click_rows)
    assert credited.count() == len(searches)
    assert credited.agg(F.sum("veces_clickeado")).first()[0] == len(want)


@pytest.mark.parametrize("ends,expected", [([5, 9], 5), ([1, 9], 9), ([1], None), ([], None), ([3], 3)])
def test_first_end_after_start_wins(spark, ends, expected):
    from datetime import datetime
    start = spark.createDataFrame([("s", datetime(2024, 1, 3))], "session_id string, started_at timestamp_ntz")
    rows = spark.createDataFrame([("s", datetime(2024, 1, d)) for d in ends] + [("other", datetime(2024, 1, 1))],
                                 schemas.SESSION_ENDS)
    got = activity.close_sessions(start, rows).collect()[0].ended_at
    assert got == (None if expected is None else datetime(2024, 1, expected))


def test_second_round_asks_for_what_is_missing(spark):
    from coursequarry.sources.requests import web_requests

    topics = prepare_topics(spark.createDataFrame([(1, "a", "es", "Todos"), (2, "b", "es", "Todos")],
                                                  "query_id long, tema string, idioma_ui string, nivel string"))
    items = items_of(spark, [(1, 1, 0, "http://a.edu", "curso", None), (1, 1, 1, "http://x.com", "nada", None),
                             (1, 1, 2, "http://b.com", "curso", None), (1, 2, 0, "http://c.com", "curso", None)])
    got = {(r.query_id, r.ronda): r.num for r in web_requests(topics, items).collect()}
    assert got == {(1, 1): 6, (1, 2): 8, (2, 1): 6, (2, 2): 10}


def test_several_replies_for_a_row_count_once(spark, sf_dir):
    from coursequarry.operators.enrich import enrich

    rows, replies = b.ai_input(spark, sf_dir), b.ai_replies(spark, sf_dir)
    assert replies.groupBy("query_id", "id").count().where("count > 1").count() > 0
    assert enrich(rows, replies).count() == rows.count()


def test_csv_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('titulo,url,confianza\n"Uno, dos",http://a.com,0.5\n"x\ny",http://b.com,nan\n')
    (tmp_path / "in" / "b.csv").write_text('\ufeffurl,otra,titulo\nhttp://c.com,1,Tres\n')
    got = {r.url: (r.titulo, r.confianza) for r in csv_files.import_results(spark, str(tmp_path / "in"), b.now()).collect()}
    assert got == {"http://a.com": ("Uno, dos", 0.5), "http://b.com": ("x\ny", 0.8), "http://c.com": ("Tres", 0.8)}


def test_writers_and_readers(spark, sf_dir, tmp_path):
    topics = topics_of(spark, [(1, "historia", "es", "Todos"), (2, "arte", "en", "Todos")])
    results = multilayer_search(topics, b.now(), catalogue=cat.seed_platforms(spark))
    for _ in range(2):
        activity_log.append_search_events(results, topics, b.now(), str(tmp_path / "log"))
    logged = activity_log.read_table(spark, str(tmp_path / "log"), schemas.SEARCH_LOG)
    assert {(r.search_id, r.tema) for r in logged.collect()} == {(1, "historia"), (2, "arte")} and logged.count() == 4

    feedback = b.feedback(spark, sf_dir)
    activity_log.append_feedback(feedback, str(tmp_path / "feedback"))
    assert spark.read.parquet(str(tmp_path / "feedback")).exceptAll(feedback).isEmpty()

    settings = b.settings_log(spark, sf_dir)
    activity_log.append_setting(settings, str(tmp_path / "settings"))
    stored = spark.read.parquet(str(tmp_path / "settings"))
    assert activity.settings_latest(stored).exceptAll(activity.settings_latest(settings)).isEmpty()

    from coursequarry.plans.report import report_rows
    report = report_rows(results)
    csv_files.export_report(report, str(tmp_path / "report"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "report"))
    assert back.columns == report.columns and back.count() == report.count()


def test_replies_when_scoring_is_off(spark):
    from coursequarry.functions import replies as rp

    row = spark.range(1).select(rp.disabled_strict(F.lit(0.7)).alias("s"), rp.disabled_loose().alias("l")).first()
    assert (row.s.valida, row.s.analisis.calidad_ia, row.s.analisis.advertencias) == (False, 0.7, [fv.DISABLED_WARNING])
    assert (row.l.valida, row.l.analisis.relevancia_ia) == (False, fv.LOOSE_DEFAULT_SCORE)


def test_a_topic_in_the_news_is_spread(spark):
    """A million clicks on one topic in one hour: no task's share of the window is more than a minute's."""
    clicks = spark.range(1_000_000).selectExpr(
        "id as click_id", "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, (id % 3600)) as ts", "'t' as tema")
    log = spark.range(60).selectExpr(
        "id as search_id", "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, id) as ts", "'t' as tema")
    got = activity.click_attribution(log, clicks)
    assert sum(r.veces_clickeado for r in got.collect()) == 1_000_000
    per_slot = clicks.groupBy(F.window("ts", activity.SLOT)).count()
    assert per_slot.agg(F.max("count")).first()[0] < 20_000


def test_keywords_of_few_syllables_meet_few_tokens(spark):
    """Words that share their first three letters with hundreds of others are compared with hardly more than they match."""
    from coursequarry.operators import topic_match as tm

    rnd = random.Random(5)
    parts = ["the", "ing", "tion", "ble", "ción", "eux", "re", "th", "ñas", "ung", "en", "a"]
    word = lambda most: "".join(rnd.choices(parts, k=rnd.randint(1, most)))
    tokens = {word(5) for _ in range(1500)} | {"x" * 250 + "theingtionble" + "y" * 300, "𝔘the", "t"}
    keywords = {word(4) for _ in range(800)} | {"t", "theingtionblex", "theingtionble", "x" * 30, "𝔘the"}
    known = spark.createDataFrame([(t,) for t in tokens], "ficha string").withColumn("clave", F.xxhash64("ficha"))
    wanted = spark.createDataFrame([(k,) for k in keywords], "palabra string")
    want = {(t, k) for t in tokens for k in keywords if k in t}
    got = [(r.ficha, r.palabra) for r in tm.token_keywords(known.select("ficha"), wanted).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert tm.may_contain(known, wanted).count() < 2 * len(want)


def test_relevance_shuffles_no_text_per_place(spark, sf_dir):
    """Topics meet the places first; the texts of pages join last, so their rows are not exchanged once per place."""
    from bindings.queries import relevance

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = relevance(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 2 and "page_id" in joins[0] and "query_id" in joins[1]
