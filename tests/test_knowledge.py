"""Text, chunks, corpus, index and search against plain loops on small fixtures."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from procwatch.functions import chunking, steps as st, text as tx
from procwatch.operators import corpus, index, remedy, search
from procwatch.sources import files


def _one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


@pytest.mark.parametrize("text", ["", " \n", "a", " A  b c d\x85e\x1cf ", "x\ny", None])
def test_words_are_those_of_split(spark, text):
    row = _one(spark, text, tx.words(F.col("t")).alias("w"), tx.strip(F.col("t")).alias("s"))
    assert row["w"] == (None if text is None else text.split())
    assert row["s"] == (None if text is None else text.strip())


def test_hash_bucket_is_md5_modulo(spark):
    tokens = [f"tok{i}" for i in range(300)] + ["a", "0"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    for size in (384, 7, 1000):
        got = {r["t"]: r["b"] for r in df.select("t", tx.hash_bucket(F.col("t"), size).alias("b")).collect()}
        assert got == {t: int(hashlib.md5(t.encode()).hexdigest(), 16) % size for t in tokens}


def test_hashed_id(spark):
    row = _one(spark, "p", tx.hashed_id(F.col("t"), F.lit("3")))
    assert row[0] == hashlib.sha1(b"p::3").hexdigest()[:16]


def _chunks(text, size, overlap, break_at=r"\n\s*\n"):
    """The packing rule as a loop over word counts."""
    done, words, fresh = [], [], []
    for para in (p.strip() for p in re.split(break_at, text)):
        if not para:
            continue
        if fresh and sum(len(f.split()) for f in fresh) + len(para.split()) > size:
            done.append("\n\n".join(fresh))
            words = done[-1].split()[-overlap:]
            fresh = [" ".join(words)]
        fresh.append(para)
    done += ["\n\n".join(fresh)] if fresh else []
    out = []
    for chunk in done:
        words = chunk.split()
        out += [chunk] if len(words) <= 1.5 * size else [
            " ".join(words[i:i + size]) for i in range(0, len(words), size - overlap)]
    return out


@pytest.mark.parametrize("size,overlap", [(8, 2), (20, 5), (220, 40)])
def test_chunker_equals_loop(spark, size, overlap):
    rnd = random.Random(size)
    texts = ["", " \n ", "one"] + ["".join(
        rnd.choice(["\n\n", "\n \n", "\n", " "]) + " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(30)))
        for _ in range(rnd.randrange(1, 12))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", chunking.chunk_text(F.col("t"), size, overlap).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [_chunks(t, size, overlap) for t in texts]


def test_chunks_of_odd_texts(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [None, "", "\n\n", "a b" + "".join(f"{s}x" for s in spaces), "\n\n".join(f"{s}p{s}" for s in spaces), "long " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    cut = df.select("i", chunking.chunk_text(F.col("t"), 8, 0).alias("c"))
    got = {r["i"]: r["c"] for r in cut.collect()}
    assert got[0] is None and got[1] == got[2] == [] and len(got[5]) == 13
    words = [r["w"] for r in df.where("i = 3").select(F.explode(tx.words(F.col("t"))).alias("w")).collect()]
    assert " ".join(got[3]).split() == words == texts[3].split() and len(words) == len(spaces) + 2
    # packed paragraph by paragraph outside the interpreted expressions, which took 45 s for 98 MB
    plan = cut._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan


def test_cards_take_the_chunks_of_the_stored_index(spark):
    from procwatch.plans import remedies
    for name in ("card_citations", "card_context", "card_confidence"):
        read = remedies.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert not [f for f in read if "documents.parquet" in f] and [f for f in read if "/index/" in f]


def test_front_matter(spark):
    text = "---\nid: X-1 r2\nbad line\ntitle: 'A: b'\nid : \"X-2\"\n---\n\n# Body\ntext --- more\n"
    row = _one(spark, text, chunking.front_matter(F.col("t")).alias("m"), chunking.body(F.col("t")).alias("b"))
    assert row["m"] == {"id": "X-2", "title": "A: b"} and row["b"] == "# Body\ntext --- more"
    for plain in ("no block", "--- only one"):
        row = _one(spark, plain, chunking.front_matter(F.col("t")).alias("m"), chunking.body(F.col("t")).alias("b"))
        assert row["m"] is None and row["b"] == plain


@pytest.mark.parametrize("path,kind", [
    ("capa/maintenance_log.csv", "maintenance"), ("capa/capa_records.csv", "capa"),
    ("sop/notes.md", "sop"), ("SOP/OEM_manual.md", "oem"), ("x/y.md", "document"),
    ("batch/deviation_7.txt", "deviation")])
def test_file_name_decides_before_folder(spark, path, kind):
    assert _one(spark, path, chunking.infer_source_type(F.col("t")))[0] == kind


def test_records_read_none_only_where_a_value_is_missing(spark):
    rows = spark.createDataFrame([("W1", "A", None)], "wo_id string, asset string, findings string")
    text = rows.select(corpus.verbalize(rows, "maintenance")).first()[0]
    assert text.startswith("Maintenance work order W1 on A (None)")
    assert "Findings: None." in text and text.endswith("Technician note: -")
    other = spark.createDataFrame([(1, "x")], "a int, b string")
    assert other.select(corpus.verbalize(other, "misc")).first()[0] == '{"a":1,"b":"x"}'


def test_equal_records_stay_apart_and_appending_is_idempotent(spark):
    rows = spark.createDataFrame([("B1", "ph")] * 40 + [("B2", "ph")], "batch_id string, parameter string")
    chunks = corpus.record_chunks(rows.repartition(4), "batch", "batch/b.json")
    assert chunks.select("chunk_id").distinct().count() == 41
    grown = corpus.append_chunks(chunks.limit(0), chunks)
    assert corpus.append_chunks(grown, chunks).count() == 41
    stats = {r["source_type"]: r[:] for r in corpus.corpus_stats(chunks).collect()}
    assert stats["all"] == ("all", 41, 41, 0) and stats["batch"] == ("batch", 41, 41, 0)


def test_text_files_are_found_below_the_root(spark, tmp_path):
    (tmp_path / "sop" / "deep").mkdir(parents=True)
    (tmp_path / "sop" / "a one.md").write_text("---\nid: S-1\nparam: ph\n---\nStep 1. Do.\n")
    (tmp_path / "sop" / "deep" / "b.TXT").write_bytes(b"caf\xff ok")
    (tmp_path / "sop" / "empty.md").write_text("  \n")
    (tmp_path / "sop" / "c.csv").write_text("x")
    docs = files.text_documents(spark, str(tmp_path))
    assert {r["path"]: r["text"][:3] for r in docs.collect()} == {"sop/a one.md": "---", "sop/deep/b.TXT": "caf"}
    described = {r["source_id"]: r for r in corpus.describe_documents(docs).collect()}
    assert described["S-1"]["param"] == "ph" and described["S-1"]["source_type"] == "sop"
    assert described["b"]["title"] == "b" and described["b"]["text"] == "caf ok"


# ---- search --------------------------------------------------------------------

WORDS = "pump valve filter temp rises falls check reset the of and seal coolant".split()


@pytest.fixture(scope="module")
def chunk_rows():
    rnd = random.Random(11)
    rows = []
    for i in range(90):
        text = " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 25)))
        rows.append((f"c{i:03d}", text, rnd.choice(["sop", "oem", "capa"]), rnd.choice(["ph", "temp", None])))
    rows += [(f"d{i:03d}", "Valve reset, valve CHECK!", "sop", "ph") for i in range(60)]  # copies
    rows += [("e000", "", "oem", None)]
    return rows


@pytest.fixture(scope="module")
def built(spark, chunk_rows):
    chunks = spark.createDataFrame(chunk_rows, "chunk_id string, text string, source_type string, param string")
    return index.Index.of(chunks.repartition(6).withColumn("source_id", F.col("chunk_id"))
                          .withColumn("title", F.lit("t")))


QUERIES = [("q1", "valve check valve", "ph", ["sop"]), ("q2", "coolant rises of the", None, None),
           ("q3", "seal unknownword", "temp", ["batch"]), ("q4", "", None, ["oem"]),
           ("q5", "reset", "hum", ["oem", "capa"])]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, text string, param string, source_types array<string>")


def _vector(text):
    v = np.zeros(384)
    for t in re.findall("[a-z0-9]+", text.lower()):
        v[int(hashlib.md5(t.encode()).hexdigest(), 16) % 384] += 1
    return v / max(np.linalg.norm(v), 1e-9)


def _brute(rows, text, param, types, alpha=0.6):
    docs = [r[1].lower().split() for r in rows]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for w in {w for d in docs for w in d}}
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    lex = np.array([sum((idf[w] if idf[w] >= 0 else floor) * d.count(w) * 2.5
                        / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg))
                        for w in text.lower().split() if w in idf) for d in docs])
    dense = np.array([_vector(r[1]) @ _vector(text) for r in rows])
    keep = [i for i, r in enumerate(rows) if (param is None or r[3] in (None, param))
            and (types is None or r[2] in types)] or list(range(n))
    lex, dense = lex[keep], dense[keep]
    unit = lambda x: (x - x.min()) / ((x.max() - x.min()) or 1.0)
    score = np.round(alpha * unit(dense) + (1 - alpha) * unit(lex), 9)
    order = sorted(range(len(keep)), key=lambda i: (-score[i], rows[keep[i]][0]))
    return [(rows[keep[i]][0], score[i]) for i in order]


@pytest.mark.parametrize("block", [128, 2])
def test_search_equals_brute_force(queries, built, chunk_rows, block):
    hits = search.search(queries, built, top_k=30, mmr=False, block=block).collect()
    for name, text, param, types in QUERIES:
        want = _brute(chunk_rows, text, param, types)[:30]
        got = sorted(((r["rank"], r["chunk_id"], r["score"]) for r in hits if r["query_id"] == name))
        assert [g[1] for g in got] == [w[0] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[1] for w in want], abs=1e-8)


def test_blocks_beyond_the_broadcast(queries, built, monkeypatch):
    """Slices are dealt out with a copy of all blocks each: no task has more than its share of the index."""
    want = sorted(search.search(queries, built, mmr=False, block=2).collect())
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "SLICE_DEALS", 16)
    assert sorted(search.search(queries, built, mmr=False, block=2).collect()) == want
    blocks, n_blocks = search.query_blocks(queries, built, 2)
    slices = search._slices(search._scan(built.entries.repartition(40)), 1)
    n_slices = slices.count()
    met = search._meet(slices, blocks, n_blocks)
    assert "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString()
    share = met.groupBy(F.pmod(F.xxhash64("slice"), F.lit(16)), F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in share) == n_slices * blocks.count()
    assert len(share) > 8 and max(r["count"] for r in share) < n_slices * n_blocks / 3


def test_small_slices_give_the_same(queries, built, monkeypatch):
    whole = search.search(queries, built, mmr=False).collect()
    monkeypatch.setattr(search, "_SLICE_CELLS", 1)
    assert sorted(search.search(queries, built, mmr=False).collect()) == sorted(whole)


def test_filters_and_fallback(queries, built):
    strict = search.search(queries, built, mmr=False, fallback_to_all=False)
    found = {r["query_id"] for r in strict.collect()}
    assert "q3" not in found and "q1" in found
    payload = strict.where("query_id = 'q1'").join(built.chunks, "chunk_id").collect()
    assert {r["param"] for r in payload} <= {"ph", None} and {r["source_type"] for r in payload} == {"sop"}
    counts = {r["query_id"]: r[1:] for r in search.candidate_counts(queries, built.kinds).collect()}
    assert counts["q3"] == (0, 1) and counts["q2"] == (151, 0)


def _mmr(vectors, k, lam=0.72):
    picked, pool = [], list(range(len(vectors)))
    while pool and len(picked) < k:
        if picked:
            best = max(pool, key=lambda c: (lam * (1 - pool.index(c) / len(pool)) - (1 - lam) * max(
                float(vectors[p] @ vectors[c]) for p in picked), -pool.index(c)))
        else:
            best = pool[0]
        picked.append(best)
        pool.remove(best)
    return picked


def test_mmr_by_hand_and_by_loop():
    # after row 0: row 1 copies it, 0.72 x 1 - 0.28 x 1 = 0.44, row 2 does not, 0.72 x 2/3 = 0.48
    vectors = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])
    assert search.mmr_order(vectors @ vectors.T, 4) == [0, 2, 1, 3]
    assert search.mmr_order(np.zeros((0, 0)), 3) == []
    rng = np.random.default_rng(4)
    for _ in range(30):
        v = rng.random((rng.integers(1, 25), 6))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        assert search.mmr_order(v @ v.T, 6) == _mmr(v, 6)


def test_reranked_hits(queries, built, chunk_rows):
    hits = search.search(queries, built, top_k=6).collect()
    texts = {r[0]: r[1] for r in chunk_rows}
    for name, text, param, types in QUERIES:
        pool = _brute(chunk_rows, text, param, types)[:24]
        want = _mmr(np.array([_vector(texts[c]) for c, _ in pool]), 6)
        got = [r["chunk_id"] for r in sorted(hits, key=lambda r: r["rank"]) if r["query_id"] == name]
        assert got == [pool[i][0] for i in want]


def test_index_survives_writing(spark, built, queries, tmp_path):
    built.write(str(tmp_path))
    again = index.Index.read(spark, str(tmp_path))
    assert sorted(search.search(queries, again).collect()) == sorted(search.search(queries, built).collect())
    row = again.entries.where("chunk_id = 'c001'").select(index.dense_vector()).first()[0]
    assert len(row) == 384 and sum(x * x for x in row) == pytest.approx(1.0, abs=1e-5)


def _jobs(spark, run):
    """How many jobs a function starts."""
    group = f"jobs-{run.__name__}-{id(run)}"
    spark.sparkContext.setJobGroup(group, "counted")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_queries(spark, built):
    def asked(n):
        return spark.createDataFrame([(f"q{i}", "valve check", None, None) for i in range(n)],
                                     "query_id string, text string, param string, source_types array<string>")

    def few():
        search.search(asked(4), built, block=8).collect()

    def many():
        search.search(asked(40), built, block=8).collect()
    few()
    assert abs(_jobs(spark, many) - _jobs(spark, few)) <= 2  # adaptive plans differ a little


def test_searches_read_the_files_of_their_types(built, spark):
    asked = spark.createDataFrame([("a", "valve", None, ["sop"]), ("b", "seal", None, ["sop", "none"])],
                                  "query_id string, text string, param string, source_types array<string>")
    entries = search.wanted_entries(asked, built)
    assert {f.split("source_type=")[1].split("/")[0] for f in entries.inputFiles()} >= {"sop"}
    assert "PartitionFilters: [" in entries._jdf.queryExecution().executedPlan().toString()
    assert entries.select("source_type").distinct().collect() == [("sop",)]
    falls_back = spark.createDataFrame([("a", "valve", None, ["none"])], asked.schema)
    assert search.wanted_entries(falls_back, built) is built.entries


def test_appending_to_an_index_equals_building_it(spark, built, queries):
    first = index.Index.of(built.chunks.where("chunk_id < 'c040'"))
    grown = first.append(built.chunks).append(built.chunks)  # the second time nothing is new
    for name in ("terms", "kinds", "size"):
        a, b = getattr(grown, name), getattr(built, name)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    assert sorted(search.search(queries, grown).collect()) == sorted(search.search(queries, built).collect())


def test_nearest_with_text_keys(spark):
    b = spark.createDataFrame([("x", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0])], "id string, v array<float>")
    q = spark.createDataFrame([("one", [1.0, 0.0])], "qid string, v array<double>")
    got = search.nearest(b, q, "id", "v", "qid", 2).collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        ("one", "b", 0), ("one", "x", 1)]


def test_nearest_blocks(spark):
    rng = np.random.default_rng(2)
    base = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(80)]
    ask = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(7)]
    b = spark.createDataFrame(base, "id long, v array<float>").repartition(3)
    q = spark.createDataFrame(ask, "qid int, v array<double>")
    got = search.nearest(b, q, "id", "v", "qid", 4, block=3).collect()
    m = np.array([v for _, v in base], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i, v in ask:
        want = np.argsort(-(m @ np.array(v)), kind="stable")[:4].tolist()
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want


# ---- steps and cards --------------------------------------------------------------

def test_step_sentences(spark):
    text = ("# Title\nStep 1.  Check the  pump\tpressure now. \nStep 2. Close valve.\n\n# Heading\n\n"
            "Step 3. Reset the unit and wait for a minute.")
    got = _one(spark, text, st.step_sentences(F.col("t")))[0]
    assert got == ["Check the pump pressure now.", "Reset the unit and wait for a minute."]  # 2 is lost


def test_numbered_steps(spark):
    text = "Intro\n 1. Do this [SOP-1] now [OEM-2]\n2) Next thing\n- no\n3.Third[X]\n4. d\n5. e\n6. f"
    got = _one(spark, text, st.numbered_steps(F.col("t")))[0]
    assert [tuple(s) for s in got] == [(1, "Do this now", "SOP-1, OEM-2"), (2, "Next thing", ""),
                                       (3, "Third", "X"), (4, "d", ""), (5, "e", "")]


def test_steps_are_distinct_and_limited(spark):
    rows = [("k", 0, "sop", "Step 1. Reduce the coolant setpoint slowly. Step 2. Short one. "
                            "Step 3. Verify the discharge temperature.", "S-1"),
            ("k", 1, "sop", "Step 1. REDUCE the coolant setpoint slowly. Step 2. Open the bypass valve by hand. "
                            "Step 3. Write a deviation record today. Step 4. Call the supervisor at once.", "S-2"),
            ("k", 2, "oem", "Step 1. Not from a procedure at all, sorry.", "O-1")]
    df = spark.createDataFrame(rows, "key string, position int, source_type string, text string, citation string")
    got = remedy.sop_steps(df, ["key"]).orderBy("order").collect()
    assert [(r["order"], r["citation"]) for r in got] == [(1, "S-1"), (2, "S-1"), (3, "S-2"), (4, "S-2")]
    assert got[3]["action"] == "Write a deviation record today."


def test_fusion_keeps_first_intent_and_order(spark):
    hits = spark.createDataFrame(
        [("k", 0, "sop", 0, "a"), ("k", 0, "sop", 1, "b"), ("k", 1, "capa", 0, "c"),
         ("k", 1, "capa", 1, "b"), ("k", 2, "oem", 0, "d")],
        "key string, subq_no int, intent string, rank int, chunk_id string")
    got = remedy.fuse(hits, ["key"]).orderBy("position").collect()
    assert [(r["chunk_id"], r["intent"]) for r in got] == [("b", "sop"), ("a", "sop"), ("c", "capa"), ("d", "oem")]
    assert got[0]["score"] == pytest.approx(2 / 61)


@pytest.fixture(scope="module")
def plant(spark):
    """A few procedures and records of our own."""
    docs = spark.createDataFrame([
        ("sop/SOP-T-1.md", "---\nid: SOP-T-1 r1\ntype: sop\nparam: temp\n---\n# Reactor Temperature\n\n"
         "Step 1. Compare the probe with its redundant twin.\n\n"
         "Step 2. Lower the coolant setpoint in small increments.\n\n"
         "Step 3. Read the exchanger differential pressure twice."),
        ("sop/SOP-P-1.md", "---\nid: SOP-P-1 r1\nparam: ph\n---\nStep 1. Stop the dosing pump and note the pH value."),
        ("oem/OEM_chiller.md", "The coolant_flow_rate of the chiller affects Reactor Temperature.")],
        "path string, text string")
    capa = spark.createDataFrame([("CAPA-1", "temp", "BR-12", "Reactor Temperature excursions seen")],
                                 "capa_id string, parameter string, asset string, problem string")
    return index.Index.of(corpus.union_corpus(
        corpus.document_chunks(corpus.describe_documents(docs)),
        corpus.record_chunks(capa, "capa", "capa/capa_records.csv")))


def test_cards_are_cited_and_follow_the_signature_rule(spark, dim, plant):
    events = spark.createDataFrame([
        ("e1", "temp", None, 38.2, "alarm", 0.4, "coolant_flow_rate"),
        ("e2", "ph", "BR-9", 6.5, "alarm", 0.2, ""), ("e3", "cond", None, 1200.0, "trip", 0.4, None),
        ("e4", "hum", None, 60.0, "alarm", 0.92, ""), ("e5", "nope", None, 1.0, "trip", 1.0, "")],
        "event_id string, param string, asset string, v_avg double, zone string, p_breach double, top_driver string")
    assert [r["event_id"] for r in remedy.unplanned(events, dim).collect()] == ["e5"]
    cards = {r["event_id"]: r for r in remedy.remedy_cards(events, dim, plant).collect()}
    assert set(cards) == {"e1", "e2", "e3", "e4"}
    e1 = cards["e1"]
    assert "SOP-T-1 r1" in e1["citations"] and e1["asset"] == "BR-12" and e1["requires_esign"] is False
    actions = [s["action"] for s in e1["steps"]]
    assert len(actions) == len(set(actions)) == 3 and len(e1["sub_questions"]) == 3
    assert e1["steps"][0]["citation"] == "SOP-T-1 r1" and 0.45 < e1["confidence"] <= 0.98
    assert "36.5-37.5 degC" in e1["sub_questions"][0] and "goes above" in e1["sub_questions"][0]
    assert cards["e2"]["asset"] == "BR-9" and "PH-009" in cards["e2"]["esign_reason"]
    assert "goes below" in cards["e2"]["sub_questions"][0]
    assert "acid_base_dose_rate" in cards["e2"]["sub_questions"][2]
    assert [cards[e]["requires_esign"] for e in ("e2", "e3", "e4")] == [True, True, True]
    assert cards["e3"]["root_cause"].startswith("Salt")


def test_card_without_procedure_escalates(spark, dim):
    chunks = spark.createDataFrame([("x", "nothing useful", "oem", "X-1", "t", None)],
                                   "chunk_id string, text string, source_type string, source_id string, "
                                   "title string, param string")
    events = spark.createDataFrame([("e", "hum", "", 60.0, "alarm", 0.1, "")],
                                   "event_id string, param string, asset string, v_avg double, zone string, "
                                   "p_breach double, top_driver string")
    card = remedy.remedy_cards(events, dim, index.Index.of(chunks)).first()
    assert card["steps"][0]["citation"] == "ESCALATION-DEFAULT"
    assert "Humidity (Cleanroom)" in card["steps"][0]["action"] and card["citations"] == ["X-1"]
