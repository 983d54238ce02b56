"""The pipeline's stages against what each is to do to its own input."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bilens.llm import bpe, mixing, packed, quality, queries, simhash

from .test_corpus_operators import brute_components, brute_lines, sample_rows, words_of


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(sample_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("kept_id", F.lit("clash"))


def brute_kept(rows, width=5, least=0.8):
    """The smallest id of each group of texts linked by the similarity of their shingles."""
    sets = {}
    for r in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "").encode().split()
        sets[r[0]] = frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()
    like = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    return sorted(set(brute_components(set(sets), like).values()))


def rows_of(df):
    return [tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect()]


def test_stages_one_by_one(spark, given):
    verdict = {(r["text_hash1"], r["text_hash2"]): r["kept"] for r in quality.rules(given).collect()}
    hashed = given.select(*corpus_pipeline.COLUMNS, *quality.text_hashes("text", "lang")).collect()
    good = corpus_pipeline.quality_rules(spark, given, "")
    assert good.columns == corpus_pipeline.COLUMNS
    assert collections.Counter(rows_of(good)) == collections.Counter(tuple(r)[:5] for r in hashed if verdict[r["text_hash1"], r["text_hash2"]])

    rows = rows_of(good)
    deduped = corpus_pipeline.line_dedup(spark, good, "")
    expected = [(i, t) for (i, t, n, d) in brute_lines(rows) if d == 0 or words_of(t)]
    assert sorted((r[0], r[1]) for r in rows_of(deduped)) == sorted(expected)
    assert all(r[4] == len(r[1]) for r in rows_of(deduped))

    rows = rows_of(deduped)
    near = corpus_pipeline.near_dedup(spark, deduped, "")
    assert sorted(r[0] for r in rows_of(near)) == brute_kept(rows)

    mixed = corpus_pipeline.mix_sources(spark, near, "")
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(near).collect()}
    assert collections.Counter(r[0] for r in rows_of(mixed)) == collections.Counter({i: n for i, n in copies.items() if n})

    model = bpe.load(bpe.vocabulary_path())
    texts = {r[0]: r[1] for r in rows_of(mixed)}
    coded = corpus_pipeline.encode(spark, mixed, "").collect()
    assert len(coded) == mixed.count() and all(bytes(r["ids"]) == model.encode(texts[r["doc_id"]]) and r["round_trip"] for r in coded)


def test_whole_run_and_no_rows(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_rows_without_an_id_are_judged_too(spark):
    text = " ".join(f"word{k} other{k * 7}" for k in range(80))
    docs = spark.createDataFrame([(None, text, "en", "s", 1), (None, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, "junk", "en", "s", 1), (2, "junk", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(str(r[0]) for r in rows_of(corpus_pipeline.near_dedup(spark, docs, ""))) == ["1", "2"]
    assert collections.Counter(str(r[0]) for r in rows_of(corpus_pipeline.quality_rules(spark, docs, ""))) == {"1": 2, "None": 2}
    unnamed = corpus_pipeline.near_dedup(spark, docs.filter("doc_id IS NULL"), "")
    assert sorted(r[1] for r in rows_of(unnamed)) == ["junk", text]


def test_one_bad_text_does_not_remove_a_good_one_of_its_id(spark):
    text = " ".join(f"word{k} other{k * 7}" for k in range(80))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, "junk", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r[1] for r in rows_of(corpus_pipeline.quality_rules(spark, docs, ""))] == [text]


@pytest.mark.parametrize("dense", [2, simhash.DENSE_BUCKET])
def test_near_copies_are_found(spark, dense):
    """Copies with a few words changed, of 0.8 similarity and more, against a comparison of all pairs."""
    rng = random.Random(23)
    vocabulary = ["".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(120, 500))]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, len(words) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string"), dense=dense).count()
    truth = len(brute_kept([(i, t, None, None, None) for i, t in rows]))
    # Every link is verified, so no two unlike documents are one; nearly all copies are found.
    assert truth <= kept <= truth + 0.1 * (len(rows) - truth)


@pytest.mark.parametrize("dense", [2, simhash.DENSE_BUCKET])
def test_crowded_segments_lose_no_link(spark, dense, monkeypatch):
    """However many nodes share a segment, the groups are those of all pairs that segments and codes allow."""
    monkeypatch.setattr(simhash._crowd_links, "__defaults__", (16, 8))
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, chains = [], [[rng.choice(vocabulary) for _ in range(150)] for _ in range(3)]
    for k in range(150):
        # Each is some words from the one before, so that ends of a chain are alike by those between alone.
        words = chains[k % 3] = list(chains[k % 3])
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, " ".join(words)))
    sets = [simhash.distinct_shingles(t, 5) for _, t in rows]
    made = [simhash.long_fingerprint(x) for x in sets]

    def linked(a, b):
        (code, mine), (other, theirs) = made[a], made[b]
        meet = any((x ^ y).bit_count() <= 1 for x, y in zip(mine, theirs)) and ((code ^ other) % 2**64).bit_count() <= simhash.CODE_BITS
        return meet and simhash._alike(sets[a], sets[b], 0.8)

    keys = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = keys.select("doc_id", *packed.row_keys("doc_id", "text")).join(simhash.representatives(keys, dense=dense), ["k1", "k2"])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(range(len(rows)), linked).values()))


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.rules(docs).join(labels, "doc_id").filter("NOT base_failed")
    assert kept.filter("quality = 1 AND NOT kept").count() == 0


def test_every_operator_has_a_query():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_sql_agrees(spark, sf):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect()), name


def test_simhash_module_defaults():
    assert (simhash.SHINGLE_WORDS, simhash.MAX_DISTANCE) == (3, 2)


def test_kept_tables_can_be_deleted(spark):
    import os

    from bilens.llm import storage

    storage.release(spark)
    kept = storage.stored(spark.range(5), "test")
    assert kept.count() == 5 and storage._made[-1].startswith(storage.shared_dir(spark))
    path = storage._made[-1].removeprefix("file://")
    assert os.path.isdir(path) and storage.release(spark) == 1 and not os.path.exists(path)
