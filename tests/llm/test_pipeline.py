"""The pipeline's stages on small documents, against what each should do."""

import random

import corpus_pipeline
from tidemark.llm import quality


def corpus():
    rnd = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    line = lambda: " ".join(rnd.choice(words) for _ in range(14)).capitalize() + "."
    clean = ["\n".join(line() for _ in range(8)) for _ in range(12)]
    texts = clean + [clean[0], clean[0], clean[1].upper().lower(), "menu | a | b | c | d\n" * 20, "", None, clean[2] + "\nWrite to a.b@c.de or +1 (743) 555-3824 today, please do it."]
    texts += ["\n".join(line() for _ in range(8)) + "\nWrite to d.e@f.org or +1 (743) 555-1234 today, please do it."]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def first_of_groups(texts):
    """Ids of the first text of each group of texts with a five-word Jaccard similarity of 0.8 or more, by all pairs."""
    sets, group = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return set(group.values())


def test_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    stay = {*range(15), 18, 19}
    assert {r["doc_id"] for r in kept.collect()} == stay and kept.columns == docs.columns
    unique = corpus_pipeline.STAGES[1][1](spark, kept, str(tmp_path))
    first = first_of_groups({i: t for i, t, *_ in rows if i in stay})
    assert first == {*range(12), 19}
    assert {r["doc_id"] for r in unique.collect()} == first and unique.columns == docs.columns
    safe = {r["doc_id"]: r for r in corpus_pipeline.STAGES[2][1](spark, unique, str(tmp_path)).collect()}
    assert set(safe) == first and all(safe[i]["text"] == rows[i][1] and safe[i]["n_chars"] == len(rows[i][1]) for i in first - {19})
    assert safe[19]["text"].endswith("Write to <EMAIL> or <PHONE> today, please do it.")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == first and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_empty_tables_and_other_columns(spark):
    wide = "doc_id long, text string, lang string, source string, n_chars long, spans string, _text string, component_id int"
    rows = [(i, t, lang, s, n, "x", "y", 7) for i, t, lang, s, n in corpus()]
    for docs in (spark.createDataFrame([], wide), spark.createDataFrame(rows, wide)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs.collect()


def test_repeated_ids_leave_one_row(spark):
    rows = [(1, "a b c d", "en", "s", 7)] * 3 + [(None, "x y z", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(repr, corpus_pipeline.near_dedup(spark, docs, "").collect())) == sorted(map(repr, docs.distinct().collect()))


def test_quality_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in corpus()])
    want = con.execute(quality.oracle())
    names = [c[0] for c in want.description]
    docs = spark.createDataFrame([r[:2] for r in corpus()], "doc_id long, text string")
    assert sorted(map(tuple, quality.quality(docs).select(*names).collect())) == sorted(want.fetchall())


def test_texts_that_share_an_id_stay_apart(spark):
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choice("abcdefghijklmnop") * 3 for _ in range(80))
    one, two, three, four, five = (text() for _ in range(5))
    rows = [(None, one), (None, two), (7, three), (7, four), (8, five), (9, five), (9, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr)
    assert got == sorted([(9, one), (None, two), (7, three), (7, four), (8, five)], key=repr)
