"""Corpus operators against brute force, on small tables with the cases that break things."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from bilens.llm import ann, bpe, lines, mixing, packed, quality, secret_scan, simhash, substring, suffix, urls
from bilens.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sample_rows():
    """Copies, near copies, shared passages, long texts, blanks, nulls and repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(80)
    rows = []
    for i in range(60):
        text = prose(rng.randint(30, 200))
        if i % 4 == 0:
            words = text.split()
            words[len(words) // 2 : len(words) // 2] = passage.split()[i % 7 : 60 + i % 9]
            text = " ".join(words)
        if i % 5 == 0:
            text = text.replace(" ", "\n", 3).replace(" ", "\t ", 2)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    for i in range(0, 40, 3):
        words = rows[i][1].split(" ")
        words[len(words) // 3] = "changed"
        rows.append((100 + i, " ".join(words), "en", "s0", 1))
    rows += [(200 + i, rows[7][1], "en", "s1", 1) for i in range(12)]
    rows += [
        (300, None, None, None, None), (301, "", "en", None, 0), (302, " \n\t", None, "s2", 3), (303, "one", "en", "s0", 3), (304, "one two", "en", "s0", 7),
        (305, "a" * 3000, "en", "s0", 3000), (306, "ab" * 1500, "en", "s0", 3000), (307, "é ñ ß 漢字 🙂 " * 200, None, "s0", 1), (308, passage * 3, "en", "s0", 1),
        (309, prose(6000), "en", "s0", 1), (310, "Same Line here for all of you\nother words of " + prose(20), "en", "s0", 1), (311, "same line HERE for all of you!\n" + prose(20), "en", "s0", 1),
    ]
    rows.append(rows[3])
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return sample_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The sample, with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    clash = ("id", "fp", "key", "size", "target", "copies", "row", "ranges", "bucket", "label", "node", "line", "lines", "kept", "h1", "mix_source", "kept_id", "band_group")
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return WORD.findall(text or "")


def same(df, expected):
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected))


# --- SimHash


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, linked):
    """Least member of each node's component, by plain search."""
    label = {}
    for start in sorted(codes):
        if start in label:
            continue
        label[start], todo = start, [start]
        while todo:
            x = todo.pop()
            for y in codes:
                if y not in label and linked(x, y):
                    label[y] = start
                    todo.append(y)
    return label


def test_fingerprints_and_components(spark, docs, rows, none):
    prints = {i: brute_fingerprint(t) for i, t, *_ in rows}
    label = brute_components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(lambda: 1 << 62)
    for i, f in prints.items():
        least[label[f]] = min(least[label[f]], i)
    same(simhash.near_duplicates(docs), [(i, f"{prints[i]:016x}", least[label[prints[i]]]) for i, *_ in rows])
    assert simhash.near_duplicates(none).count() == 0


def test_a_null_id_is_kept_and_never_the_least(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "A b  c"), (None, "x y z w q")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


@pytest.mark.parametrize("dense", [1, 4, 64])
def test_links_join_what_brute_force_joins_at_any_density(spark, dense):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    codes = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(c),) for c in codes], "fp bigint")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.fingerprint_links(df, dense).collect()]
    assert all(1 <= (a ^ b).bit_count() <= 2 for a, b in links)
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    assert brute_components(codes, lambda a, b: b in near[a]) == brute_components(codes, lambda a, b: (a ^ b).bit_count() <= 2)


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (3, 2), (None, 5)], "a bigint, b bigint")
    got = dict(map(tuple, connected_components(df).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}
    assert connected_components(df.filter("false")).count() == 0


# --- Repeated word windows and byte strings


def brute_windows(rows, span=13):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - span + 1):
            key = tuple(w[k : k + span])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - span + 1):
            if first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_word_windows(docs, rows, none, hot):
    same(substring.remove_repeats(docs, hot=hot).drop("kept"), brute_windows(rows))
    assert substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [4, 256])
def test_word_windows_of_a_passage_in_most_documents(spark, hot):
    rng = random.Random(9)
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [(i, " ".join(f"u{rng.randint(0, 50)}" for _ in range(20)) + " " + passage, "en", "s", 1) for i in range(120)]
    same(substring.remove_repeats(spark.createDataFrame(rows, DOCS), hot=hot).drop("kept"), brute_windows(rows))


def test_rows_without_an_id_are_left_alone(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(df).collect()} == {(None, 0), (1, 0), (2, 30)}


def repeated_id_rows():
    """Ids that repeat with other texts, with the same text, and rows without an id."""
    rng = random.Random(31)
    prose = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    shared, alone = prose(120), prose(150)
    rows = [(5, prose(20) + " " + shared), (5, alone), (3, shared), (5, shared), (5, shared), (None, prose(9) + " " + shared), (None, shared), (None, prose(200)), (7, alone + " " + shared)]
    return [(i, t, "en", "s", 1) for i, t in rows]


def test_repeated_and_missing_ids_keep_their_own_ranges(spark):
    rows = repeated_id_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for hot in (1, 256):
        same(suffix.remove_repeats(df, hot=hot).drop("kept"), brute_bytes(rows, 400))
        named = [r for r in rows if r[0] is not None]
        expected = brute_windows(named) + [(None, len(t.split()), 0, hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in rows if i is None]
        same(substring.remove_repeats(df, hot=hot).drop("kept"), expected)


def test_crowded_buckets_are_dealt_by_two_pieces(docs, rows, spark):
    """All windows of a text of few words share their least piece; the result is that of any layout."""
    rng = random.Random(8)
    few = [(900 + i, " ".join(rng.choice("ab") for _ in range(400)), "en", "s", 1) for i in range(12)] + [(950, "a " * 900, "en", "s", 1)]
    every = [*rows, *few]
    df = spark.createDataFrame(every, DOCS)
    layout = packed.plan_layout(packed.keyed(df, "doc_id", "text"), substring._weigh(13, 3), 2000)
    assert len(layout.crowded)
    same(substring.remove_repeats(df, crowded=2000, hot=4).drop("kept"), brute_windows(every))
    same(suffix.remove_repeats(df, match=96, crowded=2000, hot=4).drop("kept"), brute_bytes(every, 96))


def test_the_two_least_values():
    rng = np.random.default_rng(2)
    for width in (1, 2, 5, 8, 11):
        values = rng.integers(0, 9, 60).astype(np.uint64)
        least, second = packed.two_least(values, width)
        parts = [sorted(set(values[k : k + width].tolist())) for k in range(60 - width + 1)]
        assert least.tolist() == [p[0] for p in parts] and second.tolist() == [p[1] if len(p) > 1 else 2**64 - 1 for p in parts]


def test_covered_places():
    rng = np.random.default_rng(5)
    for _ in range(50):
        starts, lengths = rng.integers(0, 90, 12), rng.integers(1, 20, 12)
        assert set(np.flatnonzero(packed.covered(80, starts, lengths))) == {x for a, n in zip(starts, lengths) for x in range(a, a + n) if x < 80}


def brute_bytes(rows, match):
    data = [((t or "").encode(), i) for i, t, *_ in rows]
    count = Counter(d[k : k + match] for d, _ in data for k in range(len(d) - match + 1))
    out = []
    for d, i in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - match + 1):
            if count[d[k : k + match]] > 1:
                gone[k : k + match] = True
        gone = gone[: len(d)]
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((i, len(d), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("match", "hot"), [(400, 256), (96, 2), (57, 1)])
def test_byte_strings(docs, rows, none, match, hot):
    same(suffix.remove_repeats(docs, match=match, hot=hot).drop("kept"), brute_bytes(rows, match))
    assert suffix.remove_repeats(none, match=match).count() == 0


def test_the_cover_meets_every_difference():
    for period in (3, 8, 16, 31):
        cover = suffix.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_suffix_order_is_the_order_of_bytes():
    rng = random.Random(4)
    text = "".join(rng.choice("ab") for _ in range(60)) * 4 + "a" * 200
    data = text.encode()
    at = np.arange(len(data) - 96 + 1)
    sample = suffix.CoverSample(data, 96)
    i, j = (np.array([rng.choice(at) for _ in range(3000)]) for _ in range(2))
    expected = [(data[x : x + 96] > data[y : y + 96]) - (data[x : x + 96] < data[y : y + 96]) for x, y in zip(i, j)]
    assert sample.compare(i, j).tolist() == expected
    classes = suffix.equal_classes(sample, at, np.zeros(len(at), np.int64))
    names = {}
    assert len({(c, data[x : x + 96]) for c, x in zip(classes.tolist(), at.tolist())}) == len(set(classes.tolist())) == len({names.setdefault(data[x : x + 96], x) for x in at.tolist()})


# --- Lines


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_lines(rows, least=lines.MIN_SIMILARITY):
    """What stays of each document, by comparing all distinct lines with one another."""
    order = sorted({(i if i is not None else lines.NO_ID, signed(xxhash.xxh64_intdigest(t.encode(), 42)), t) for i, t, *_ in rows if t is not None})
    first = {}
    for i, mark, t in order:
        for n, plain in enumerate(lines.normalised_lines(t)):
            if plain:
                first[plain] = min(first.get(plain, (i, mark, n)), (i, mark, n))
    short = {p for p in first if p.count(b" ") + 1 < lines.FUZZY_WORDS}
    sketch = {p: set(lines.line_sketches([p])[0].tolist()) for p in first if p not in short}
    code = {p: int(lines.line_codes([p])[0]) % 2**64 for p in sketch}

    def linked(a, b):
        if (a in short) != (b in short) or a not in short and (not sketch[a] & sketch[b] or (code[a] ^ code[b]).bit_count() > lines.CODE_BITS):
            return False
        return lines.similarity(a.decode(), b.decode()) >= least

    label, keeper = brute_components(set(first), linked), {}
    for plain, at in first.items():
        keeper[label[plain]] = min(keeper.get(label[plain], at), at)
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        mark = signed(xxhash.xxh64_intdigest(t.encode(), 42))
        own = i if i is not None else lines.NO_ID
        plain = lines.normalised_lines(t)
        kept = [x for n, x in enumerate(t.split("\n")) if not plain[n] or keeper[label[plain[n]]] == (own, mark, n)]
        out.append((i, "\n".join(kept), len(plain), len(plain) - len(kept)))
    return out


def line_rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(40)]

    def varied(line):
        words = line.split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words).capitalize() + rng.choice([".", "", "!"])

    rows = [(i, "\n".join(varied(rng.choice(base)) for _ in range(rng.randint(1, 6))), "en", "s", 1) for i in range(80)]
    rows += [(200, None, "en", "s", 1), (201, "", "en", "s", 1), (202, "\n\n--\n", "en", "s", 1), (203, base[0] + "\n" + base[0], "en", "s", 1), (204, "x " * 5000, "en", "s", 1)]
    return rows


def test_lines(spark):
    rows = line_rows()
    # Ids that repeat with other texts, and rows without an id.
    rows += [(3, rows[9][1], "en", "s", 1), (3, rows[9][1].upper() + "\nand something else of its own", "en", "s", 1), (None, rows[5][1], "en", "s", 1), (None, "only here and nowhere else at all", "en", "s", 1)]
    same(lines.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)), brute_lines(rows))


def test_lines_with_some_edits_are_found(spark):
    """Recall against all pairs of the wanted similarity, in lines of words changed, added, left out or misspelt."""
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 70))] for _ in range(150)]

    def varied(words):
        words = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 7))):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1, 1])] = rng.choice([[rng.choice(vocabulary)], [], [words[at] + "x"]])
        return " ".join(words)

    forms = sorted({f for w in base for f in (" ".join(w), varied(w), varied(w)) if f.count(" ") >= 4})
    plain = [f.encode() for f in forms]
    triples, counts = lines.line_sketches(plain)
    sketches = np.split(triples, np.cumsum(counts)[:-1])
    data = [(k, int(lines.line_codes([x])[0]), len(f), s.tolist()) for k, (f, x, s) in enumerate(zip(forms, plain, sketches))]
    df = spark.createDataFrame(data, "form bigint, fp bigint, size int, sketch array<bigint>")
    truth = {(a, b) for a in range(len(forms)) for b in range(a + 1, len(forms)) if min(len(forms[a]), len(forms[b])) >= 0.8 * max(len(forms[a]), len(forms[b])) and lines.similar(forms[a], forms[b], 0.8)}
    holders = defaultdict(set)
    for k, _, _, s in data:
        for t in s:
            holders[t].add(k)
    for dense in (2, 1024):
        found = {(r["a"], r["b"]) for r in lines.form_pairs(df, 0.8, dense).collect()}
        assert len(truth) > 200 and (dense == 2 or len(found & truth) >= 0.95 * len(truth))
        # All that meet under a triple which is not crowded are found.
        near = {(a, b) for t in holders.values() if len(t) <= dense for a in t for b in t if a < b}
        codes = {k: c % 2**64 for k, c, _, _ in data}
        assert {(a, b) for a, b in near & truth if (codes[a] ^ codes[b]).bit_count() <= lines.CODE_BITS} <= found


@pytest.mark.parametrize("block", [3, 4096])
def test_crowded_triples_lose_no_link(spark, block):
    """However many forms share a triple, all that codes and lengths allow meet there, and groups are those of all pairs."""
    rng = random.Random(29)
    vocabulary = ["".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 30))] for _ in range(12)]
    forms = set()
    for k in range(150):
        words = list(base[k % 12])
        for _ in range(rng.randint(0, 1 + len(words) // 4)):
            words[rng.randrange(3, len(words))] = rng.choice(vocabulary)
        forms.add(" ".join(words))
    forms = sorted(forms)
    triples, counts = lines.line_sketches([f.encode() for f in forms])
    sketches = [set(x.tolist()) for x in np.split(triples, np.cumsum(counts)[:-1])]
    codes = [int(lines.line_codes([f.encode()])[0]) for f in forms]
    data = [(k, c, len(f), sorted(s), f) for k, (f, c, s) in enumerate(zip(forms, codes, sketches))]
    df = spark.createDataFrame(data, "form bigint, fp bigint, size int, sketch array<bigint>, text string")

    def meet(a, b):
        sizes = sorted((len(forms[a]), len(forms[b])))
        return bool(sketches[a] & sketches[b]) and ((codes[a] ^ codes[b]) % 2**64).bit_count() <= lines.CODE_BITS and sizes[0] >= 0.8 * sizes[1]

    pairs = {(a, b) for b in range(len(forms)) for a in range(b) if meet(a, b)}
    assert {(r["a"], r["b"]) for r in lines.form_pairs(df, 0.8, block).collect()} == pairs
    met = lines._met(df, 0.8, block)
    assert {(r["triple"], r["form"]) for r in met.collect()} == {(t, x) for a, b in pairs for t in sketches[a] & sketches[b] for x in (a, b)}
    linked = [(r["a"], r["b"]) for r in lines.form_links(met, df, 0.8, block).collect()]
    true = {(a, b) for a, b in pairs if lines.similarity(forms[a], forms[b]) >= 0.8}
    assert set(linked) <= true and 20 < len(true) < len(pairs)
    assert brute_components(range(len(forms)), lambda a, b: (a, b) in linked or (b, a) in linked) == brute_components(range(len(forms)), lambda a, b: (a, b) in true or (b, a) in true)
    # A group's links are some that join it under a triple, not one for each two forms.
    assert block == 3 or len(linked) < len(true)


def by_bucket(batches):
    rows = sorted((x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=lambda x: x[0])
    return iter([pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int32()), pa.array([x[1]], pa.binary())], names=["bucket", "blob"]) for x in rows])


@pytest.mark.parametrize("held, limit", [(7, 40), (1 << 16, 1 << 20)])
def test_packed_lines_and_triples_are_all_there(monkeypatch, held, limit):
    """Each form once, with its first occurrence, and every other occurrence; each triple's forms, also where a bucket is not held whole."""
    monkeypatch.setattr(lines, "HELD_LINES", held)
    monkeypatch.setattr(lines, "HELD_TRIPLES", held)
    monkeypatch.setattr(lines, "LINES_AT_ONCE", held)
    monkeypatch.setattr(lines, "BUCKET_ROWS", limit)
    monkeypatch.setattr(packed, "SCAN_BYTES", 300)
    given = [(i, signed(xxhash.xxh64_intdigest(t.encode(), 42)) if t else 42, t) for i, t, *_ in line_rows()]
    # Equal rows, and another row with the same lines.
    given += given[3:9] + [(500, 7, given[3][2])]
    places = defaultdict(set)
    for i, mark, t in given:
        for n, plain in enumerate(lines.normalised_lines(t or "")):
            if plain:
                places[plain].add((i, mark, n))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*given[a : a + 9]), (pa.int64(), pa.int64(), pa.string()))], names=["id", "mark", "text"]) for a in range(0, len(given), 9)]
    rows = [r for b in lines._form_rows(by_bucket(lines._line_rows(5)(iter(batches)))) for r in b.to_pylist()]
    forms = {(r["id"], r["mark"], r["line"]): r for r in rows if r["first"]}
    first = {min(x): plain for plain, x in places.items()}
    assert set(forms) == set(first) and len(forms) == sum(r["first"] for r in rows)
    assert {(r["id"], r["mark"], r["line"]) for r in rows if not r["first"]} == {x for at in places.values() for x in at if x != min(at)}
    for at, plain in first.items():
        r, short = forms[at], plain.count(b" ") + 1 < lines.FUZZY_WORDS
        assert (r["size"], r["short"]) == (len(plain.decode()), plain.decode() if short else None)
        assert (r["fp"], r["sketch"]) == ((None, None) if short else (int(lines.line_codes([plain])[0]), lines.line_sketches([plain])[0].tolist()))
    long = [(k, r) for k, r in enumerate(forms.values()) if r["short"] is None]
    columns = [[k for k, _ in long], *([r[c] for _, r in long] for c in ("fp", "size", "sketch"))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))], names=["form", "fp", "size", "sketch"])
    met = [r for b in lines._meeting_packed(0.8, 3)(by_bucket(lines._triple_rows(2)(iter([batch.slice(0, 20), batch.slice(20)])))) for r in b.to_pylist()]
    holders = defaultdict(list)
    for k, r in long:
        for t in r["sketch"]:
            holders[t].append((k, r))
    alike = lambda a, b: ((a["fp"] ^ b["fp"]) % 2**64).bit_count() <= lines.CODE_BITS and min(a["size"], b["size"]) >= 0.8 * max(a["size"], b["size"])
    want = {(t, k, True) for t, x in holders.items() if len(x) > 3 for k, _ in x}
    want |= {(t, k, False) for t, x in holders.items() if len(x) <= 3 for k, r in x for j, q in x if j != k and alike(r, q)}
    got = [(r["triple"], r["form"], r["crowded"]) for r in met]
    assert set(got) == want and len(got) == len(want) and len({c for *_, c in want}) == 2


def test_tables_of_lines_are_deleted_before_the_result_is_read(spark, docs, rows):
    """What is found is small; the forms of all lines are not there beside the texts that are joined with it."""
    from bilens.llm import storage

    made = len(storage._made)
    found = lines.dedup_lines(docs)
    assert len(storage._made) == made
    same(found, brute_lines(rows))
    assert found.count() == len(rows)


def test_pairs_compared_at_once_are_judged_as_one_by_one():
    rng = random.Random(4)
    texts = ["", "a", "\U0001f600b", "x" * 9000, "x" * 8000]
    for n in (3, 12, 60, 130, 600):
        for _ in range(40):
            text = "".join(rng.choice("abcdé \u4e2d") for _ in range(n))
            edited = list(text)
            for _ in range(rng.randint(0, n // 3)):
                at = rng.randrange(len(edited) + 1)
                edited[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "bc"])
            texts += [text, "".join(edited)]
    x = np.array([*range(len(texts) - 1), 3, 0, 0])
    y = np.array([*range(1, len(texts)), 4, 0, 1])
    want = [(1 - lines.edit_distance(a, b) / max(len(a), len(b)) if a or b else 1) >= 0.8 for a, b in ((texts[i], texts[j]) for i, j in zip(x, y))]
    assert lines.Texts(texts).similar(x, y, 0.8).tolist() == want and 50 < sum(want) < len(want) - 50


@pytest.mark.parametrize("shift", [0, 40, 90])
def test_long_lines_are_compared_at_once(monkeypatch, shift):
    """Lines of 600 to 1,900 characters that share a passage: none goes one by one, and edits away from the diagonal count."""
    rng = random.Random(shift)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(500))
    texts = []
    for n in (100, 400, 1400):
        for _ in range(12):
            text = "x" + "".join(rng.choice("abcdefgh ") for _ in range(n)) + passage
            edited = [rng.choice("stu") if rng.random() < rng.choice([0.1, 0.17]) else c for c in text]
            texts += [text, "".join(edited[shift:]) + "y" * shift, passage[:-shift or None] + text[500:] + "z" * shift]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if a // 36 == b // 36]
    x, y = (np.array(c) for c in zip(*pairs))
    want = [1 - lines.edit_distance(texts[a], texts[b]) / max(len(texts[a]), len(texts[b])) >= 0.8 for a, b in pairs]
    alone = []
    similar = lines.similar
    monkeypatch.setattr(lines, "similar", lambda a, b, least: alone.append((a, b)) or similar(a, b, least))
    assert lines.Texts(texts).similar(x, y, 0.8).tolist() == want and 10 < sum(want) < len(want) - 50
    assert len(alone) < 40


def test_lines_of_the_sample_and_of_nothing(docs, rows, none):
    same(lines.dedup_lines(docs), brute_lines(rows))
    kept = lines.dedup_lines(docs, keep=["lang", "id"])
    assert kept.columns == ["doc_id", "lang", "id", "text", "n_lines", "n_dropped"] and kept.filter("id <> 'clash'").count() == 0
    assert lines.dedup_lines(none).count() == 0


def test_short_lines_meet_all_similar_ones(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abdeghikln") for _ in range(rng.randint(1, 8))) for _ in range(12)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4))) for _ in range(12)] + ["".join(rng.choice("abcd") for _ in range(n)) for n in (60, 64, 70, 150)]

    def varied(line):
        for _ in range(rng.randint(0, 1 + len(line) // 6)):
            at = rng.randrange(len(line) + 1)
            line = line[:at] + rng.choice(["", "a", "e", "k"]) + line[at + rng.randint(0, 1) :]
        return line

    rows = [(i, varied(base[i % len(base)]), "en", "s", 1) for i in range(160)] + [(500, "with to to\nthth to to", "en", "s", 1)]
    first = {}
    for i, t, *_ in rows:
        for n, plain in enumerate(lines.normalised_lines(t)):
            if 0 < len(plain.split()) < lines.FUZZY_WORDS:
                first.setdefault(plain.decode(), (i, n))
    label = brute_components(set(first), lambda a, b: lines.similarity(a, b) >= lines.MIN_SIMILARITY)
    keeper = {}
    for form, at in first.items():
        keeper[label[form]] = min(keeper.get(label[form], at), at)
    assert len(keeper) < len(first)
    gone = [(i, sum(keeper[label[p.decode()]] != (i, n) for n, p in enumerate(lines.normalised_lines(t)) if p.decode() in first)) for i, t, *_ in rows]
    got = lines.dedup_lines(spark.createDataFrame(rows, DOCS))
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got.collect()) == sorted(gone)


def test_edit_distance_and_its_bounds():
    rng = random.Random(3)

    def table(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            n = [i + 1]
            for j, y in enumerate(b):
                n.append(min(d[j] + (x != y), n[j] + 1, d[j + 1] + 1))
            d = n
        return d[-1]

    for _ in range(1500):
        a = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 24)))
        b = a[: rng.randint(0, 9)] + rng.choice(["", "x", "y z"]) + a[rng.randint(3, 12) :]
        assert lines.edit_distance(a, b) == table(a, b)
        longest = max(len(a), len(b))
        assert lines.similar(a, b, 0.8) == ((1 - table(a, b) / longest if longest else 1) >= 0.8)


# --- Byte-pair encoding


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_codes_are_the_published_library_s(docs, rows, none, tokenizer):
    expected = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same(bpe.digests(docs), expected)
    assert bpe.digests(none).count() == 0
    assert bpe.encode_checked(docs).filter("NOT round_trip").count() == 0


def test_hard_texts(tokenizer):
    model, rng = bpe.load(bpe.vocabulary_path()), random.Random(6)
    texts = ["x<|endoftext|>y<|endoftext|>", "it's we'LL I'd", "\u2028\x85\x1c a\u00a0b", "a" * 30_000, "ab" * 9000, " " * 5000, "\n" * 999, "é" * 4000, "!" * 4000, "1" * 3000]
    texts += ["".join(rng.choice("abcdethinsgo") for _ in range(n)) for n in (100, 3000, 20_000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 126)])) for _ in range(400)) for _ in range(40)]
    texts.append("word " * 250_000)
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        codes = model.encode(t)
        assert np.frombuffer(codes, "<u4").tolist() == ids, t[:40]
        assert model.decode(codes) == t


def test_the_transducer_keeps_a_bounded_buffer(tokenizer):
    model, rng = bpe.load(bpe.vocabulary_path()), random.Random(1)
    data = "".join(rng.choice("aeinothrs") for _ in range(40_000)).encode()
    machine, out, most = bpe.Transducer(model), [], 0
    for at in range(0, len(data), 700):
        out += machine.feed(data[at : at + 700])
        most = max(most, len(machine.held))
    out += machine.close()
    assert out == tokenizer.encode(data.decode(), add_special_tokens=False).ids
    assert most <= 2 * bpe.STEP_BYTES + model.lookahead + 128


def test_all_tokens_come_from_the_transducer(tokenizer, monkeypatch):
    """Each distinct pre-token passes through it, in steps, and what it emits is what is encoded."""
    model, fed, given = bpe.Bpe(bpe.vocabulary_path()), [], []
    feed, close = bpe.Transducer.feed, bpe.Transducer.close

    def spy(inner, log):
        def run(self, *args):
            for token in inner(self, *args):
                log.append(token)
                yield token

        return run

    monkeypatch.setattr(bpe.Transducer, "feed", spy(feed, fed))
    monkeypatch.setattr(bpe.Transducer, "close", spy(close, given))
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinothrs") for _ in range(n)) for n in (3, 9, 40, 700, 5000, 30_000)]
    text = " ".join(words)
    ids = np.frombuffer(model.encode(text), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(fed) + len(given) == len(ids) and len(fed) > 0.9 * len(ids)
    assert np.frombuffer(model.encode(text), "<u4").tolist() == ids


def test_decoding_bytes_that_are_no_text():
    model = bpe.load(bpe.vocabulary_path())
    codes = np.array([model.start[b] for b in b"a\xe6\xbc\xa2\xff\xe6\xbcz"], "<u4").tobytes()
    assert model.decode(codes) == "a漢\ufffd\ufffdz"
    assert "".join(bpe.decode_stream(np.frombuffer(codes, "<u4"), model.table, step=1)) == "a漢\ufffd\ufffdz"


# --- Quality rules


def brute_counts(text):
    text = text or ""
    words = words_of(text)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_quality_counts(docs, rows, none):
    got = quality.rules(docs)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(got.select(*names), [(i, *brute_counts(t)) for i, t, *_ in rows])
    assert got.filter("base_failed AND kept").count() == 0
    assert quality.rules(none).count() == 0


def test_repeats_of_long_texts_and_large_vocabularies(monkeypatch):
    rng = random.Random(2)
    for size in (3, 40):
        words = [str(rng.randint(0, size)).encode() for _ in range(500)]
        assert quality.repeated_words(words) == brute_counts(b" ".join(words).decode())[4]
    assert quality.repeated_words([b"a"] * 3) == 0 and quality.repeated_words([b"a"] * 4) == 4


def test_bands_reject_what_a_vocabulary_cannot_read(spark):
    rng = random.Random(7)
    vocabulary = ["the", "of", "people", "water", "house", "under", "walking", "great", "number", "garden", "morning", "quickly", "letter", "brought", "seven", "winter", "answer", "river", "stone", "music"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "s"]) for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choice("qxzjkvQXZ#%0987") for _ in range(6)) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 900)), "en", "s", 1) for i in range(200)] + [(1000 + i, noise(400), "en", "s", 1) for i in range(10)]
    rows += [(2000 + i, "漢字仮名交じり文 " * 60 + str(i), None, "s", 1) for i in range(3)]
    got = {r["doc_id"]: r for r in quality.rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i]["kept"] for i in range(200)) and not any(got[1000 + i]["kept"] for i in range(10))
    assert got[2000]["band_group"] == "script:cjk"


def test_copies_of_a_text_do_not_narrow_the_bands(spark):
    rng = random.Random(21)
    plain = ["the", "people", "water", "house", "under", "walking", "great", "number", "garden", "morning", "quickly", "letter", "brought", "seven", "winter", "answer", "river", "stone", "music", "of"]
    made = ["".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rows = []
    for i in range(120):
        share = rng.uniform(0.3, 0.7)
        text = " ".join(rng.choice(plain) if rng.random() < share else rng.choice(made) for _ in range(600))
        rows.append((i, text, "en", "s", 1))
    kept = lambda some: {r["doc_id"] for r in quality.rules(spark.createDataFrame(some, DOCS)).filter("kept").collect()}
    alone = kept(rows)
    assert len(alone) > 100
    copied = next(r for r in rows if r[0] in alone)
    # In four fifths of the language's rows: counted by rows, both quartiles are this text's.
    assert kept([*rows, *[(1000 + k, *copied[1:]) for k in range(480)]]) == alone | {1000 + k for k in range(480)}


def test_texts_of_a_rare_language_are_not_judged_by_others(spark):
    rng = random.Random(6)
    words = ["the", "people", "water", "house", "under", "walking", "great", "number", "garden", "morning", "quickly", "letter", "brought", "seven", "winter", "answer"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(300)), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, " ".join("".join(rng.choice("汉字语言文本数据清洁人口河流早晨花园") for _ in range(4)) for _ in range(80)), "zh", "s", 1) for i in range(5)]
    rows += [(200, "short", "zh", "s", 1)]
    kept = {r["doc_id"]: r["kept"] for r in quality.rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(kept[100 + i] for i in range(5)) and not kept[200]


# --- Secrets


def brute_base(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    spans.sort()
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return [sum(k == n for _, k, _ in spans) for n in range(3)], hashlib.sha256(said.encode()).hexdigest(), said


def test_secrets(spark, rows, none):
    rng = random.Random(1)
    key = "".join(rng.choice("ABCDEFGHabcdefghijkmn0123456789+/") for _ in range(40))
    hex40 = hashlib.sha1(b"x").hexdigest()
    hard = [
        f'é🙂 PassWord = "{hex40}" and token: token: abcdefg', "password=short", "api_key:'abcdef.ghi-1' APIKEY=zzzzzz", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, f"AKIAKIA{'Z9' * 9}",
        f"see {key} there", "deadbeef" * 3, f"sum {hex40.upper()} id 123e4567-e89b-12d3-a456-426614174000", "ſecret=abcdefgh toKen=abcdefgh", None, "", "secret=secret=abc123xyz",
    ]
    rows = [*rows, *[(900 + k, t, "en", "s", 1) for k, t in enumerate(hard)]]
    got = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t, *_ in rows:
        counts, digest, said = brute_base(t)
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == [*counts, digest], t
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == [s for s in said.split(",") if s]
    assert got[905]["spans"] == f"random:4:{4 + len(key)}"
    assert got[907]["n_random"] == 0
    assert secret_scan.scan(none).count() == 0


def test_long_runs_and_many_spans_take_linear_time():
    import time

    encoding = secret_scan._encoding(*secret_scan.vocabulary())
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)) + "1"
    start = time.perf_counter()
    secret_scan.random_spans(letters, secret_scan.base_spans(letters), encoding)
    assert time.perf_counter() - start < 1
    many = " ".join(f"token=abc{k % 10}def" if k % 2 else "plainwordsinarowhere" for k in range(200_000))
    start = time.perf_counter()
    spans = secret_scan.base_spans(many)
    assert len(spans) == 100_000
    middle = time.perf_counter()
    secret_scan.random_spans(many, spans, encoding)
    print(middle - start, time.perf_counter() - middle)
    # The overlap test alone is a fraction of this; each run is judged by the vocabulary once.
    assert time.perf_counter() - middle < 5


def test_random_runs_of_letters_and_short_ones():
    encoding = secret_scan._encoding(*secret_scan.vocabulary())
    found = lambda text: secret_scan.random_spans(text, [], encoding)
    rng = random.Random(4)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower = "abcdefghijklmnopqrstuvwxyz"
    runs = [draw(lower + lower.upper(), n) for n in (20, 30, 40) for _ in range(50)] + [draw(lower + lower.upper() + "0123456789", n) for n in (16, 20) for _ in range(50)]
    assert sum(found(f"see {x} there") == [(4, 3, 4 + len(x))] for x in runs) >= 0.98 * len(runs)
    for plain in ("some_long_identifier_of_words", "usr/share/doc/readme/and/more", "a-b-c-d-e-f-g-h-i-j-k-l", "getElementsByTagName", "dasschzukeitkeit", "20240115T103000Z", "=" * 40, "-" * 16, "x/" * 30):
        assert found(f"see {plain} there") == [], plain
    # A nested repeat would take exponential time here; the run may be random or not.
    assert len(found("ab" * 5000 + "1")) <= 1


# --- URLs


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


def test_url_rules(spark, sf):
    hard = [None, "", "no scheme/net/", "http://", "HTTP://A.NET", "http://A.NET/", "x://example.net/en/a://b", "http://b.example.net/en/?q#f", "http://example.net/en", "http://notexample.net/en/",
            "http://fr.org/fr/x#y?z", "http://org/fr/", "http://u@h.net:80/x\ny", "http://example.com/de/?a=1&b=2", "https://xn--é.org/FR/"]
    pages = spark.createDataFrame(list(enumerate(hard)), "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    for df, urls_ in ((pages, dict(enumerate(hard))), (spark.read.parquet(f"{sf}/pages.parquet"), None)):
        urls_ = urls_ or {r["page_id"]: r["url"] for r in df.collect()}
        got = urls.filter_urls(df).collect()
        assert len(got) == len(urls_)
        for r in got:
            assert (r["host"], r["path"], r["rule"]) == brute_rule(urls_[r["page_id"]]), urls_[r["page_id"]]
            assert r["verdict"] in ("allow", "block")
            if r["rule"]:
                assert r["verdict"] == dict(urls.RULES)[r["rule"]]
    assert urls.filter_urls(pages.filter("false")).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages.filter("page_id = 0")).collect()} == {"allow"}


def test_suffix_shares_are_counted_only_where_they_are_used(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/fr/"), (3, "http://c.com/")], "page_id bigint, url string")
    labelled = spark.createDataFrame([("http://d.com/y", 1), ("http://e.org/z", 0)], "url string, block int")
    counted = []
    monkeypatch.setattr(urls, "cut", lambda df: counted.append(df) or df)
    assert urls.filter_urls(pages).count() == 3 and not counted
    assert urls.filter_urls(pages, labelled).count() == 3 and len(counted) == 1


def test_the_url_query_counts_suffix_shares(spark, sf, monkeypatch):
    """The registered query learns with the suffix shares of all URLs that the rules judge; each host, path and rule stays."""
    from bilens.llm import queries

    counted = []
    cut = urls.cut
    monkeypatch.setattr(urls, "cut", lambda df: counted.append(cut(df)) or counted[-1])
    got = {r["page_id"]: r for r in queries.op8_urls(spark, sf).collect()}
    given = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert set(got) == set(given) and all((r["host"], r["path"], r["rule"]) == brute_rule(given[i]) for i, r in got.items())
    assert all(r["verdict"] == (dict(urls.RULES)[r["rule"]] if r["rule"] else "block" if r["block_probability"] >= 0.5 else "allow") for r in got.values())
    want = Counter()
    for r in got.values():
        if r["rule"]:
            suffix = r["host"].rsplit(".", 1)[-1]
            want[suffix, "all"] += 1
            want[suffix, "blocked"] += dict(urls.RULES)[r["rule"]] == "block"
    assert len(counted) == 1 and {(r["known_suffix"], k): r[k] for r in counted[0].collect() for k in ("all", "blocked")} == {(s, k): want[s, k] for s in {x for x, _ in want} for k in ("all", "blocked")}


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(3)

    def url(bad):
        name = "".join(rng.choice("abcdefghij") for _ in range(6))
        if bad:
            return f"http://{name}-{rng.randint(1000, 99999)}-{name}.info/{rng.randint(10**6, 10**9)}?a={rng.random()}&b=2&c=3"
        return f"https://www.{name}.org/{name}/{name}"

    labelled = [(url(k % 2), k % 2) for k in range(1200)]
    fresh = [(k, url(k % 2)) for k in range(400)]
    got = urls.filter_urls(spark.createDataFrame(fresh, "page_id bigint, url string"), spark.createDataFrame(labelled, "url string, block int"), rules=())
    right = sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got.collect())
    assert right >= 390


# --- Nearest neighbours


def brute_nearest(rows, k=20):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    seen, unique = set(), []
    for i, v in sound:
        if (i, tuple(v)) not in seen:
            seen.add((i, tuple(v)))
            unique.append((i, v))
    out = {}
    for q, v in unique:
        if q % 20 == 0:
            scored = sorted((-float(sum(a * b for a, b in zip(v, w))), i) for i, w in unique if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(n=700, dims=16, copies=150):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, dims))
    rows = [(i, (centres[i % 12] + 0.4 * rng.standard_normal(dims)).astype(np.float32).tolist()) for i in range(n)]
    same_ = rows[5][1]
    rows += [(n + i, same_) for i in range(copies)]
    bad = [(5001, None), (5020, []), (5040, [0.0] * dims), (5060, [float("nan")] + [1.0] * (dims - 1)), (5080, [None] + [1.0] * (dims - 1)), (None, same_), (5100, [float("inf")] * dims), (6000, [1.0, 2.0])]
    return [*rows, *bad, rows[3], rows[20]]


def test_nearest_neighbours(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    exact = brute_nearest(rows)
    for tiles in (None, (150, 16)):
        if tiles:
            monkeypatch.setattr(ann, "TILE_VECTORS", tiles[0])
            monkeypatch.setattr(ann, "TILE_QUERIES", tiles[1])
        found = defaultdict(list)
        for r in ann.nearest(df).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append((r["vec_id"], r["score"]))
            assert r["rank"] == len(found[r["query_id"]])
        hits = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in top}) for q, top in exact.items())
        assert hits >= 0.9 * sum(map(len, exact.values()))
        assert set(found) == {q for q, top in exact.items() if top}
        scores = {(q, i): s for q, top in exact.items() for i, s in top}
        assert all(s == pytest.approx(scores[q, i], abs=1e-12) for q, top in found.items() for i, s in top if (q, i) in scores)
        assert all(top == sorted(top, key=lambda x: (-x[1], x[0])) for top in found.values())
    assert ann.nearest(df.filter("false")).count() == 0


def test_the_stopping_test_stops(spark, monkeypatch):
    """Noisy copies of some centres, of any length: most vectors are never compared in full, and most neighbours are found."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 24))
    length = np.exp(0.3 * rng.standard_normal(6000))
    points = ((centres[np.arange(6000) % 60] + 0.25 * rng.standard_normal((6000, 24))) * length[:, None]).astype(np.float32)
    monkeypatch.setattr(ann, "TILE_VECTORS", 400)
    monkeypatch.setattr(ann, "SAMPLE", 3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id bigint, embedding array<float>")
    got = ann.nearest(df).collect()
    found, compared = defaultdict(set), {}
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
        compared[r["query_id"]] = r["compared"]
    exact, hits = points.astype(float), 0
    for q in found:
        score = exact @ exact[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    assert len(found) == 300 and hits >= 0.9 * 20 * 300
    assert sum(compared.values()) <= 0.4 * 6000 * 300


def test_chi_square():
    assert ann.chi_square(ann.chi_square_quantile(0.95, 8), 8) == pytest.approx(0.95)
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


# --- Mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        whole = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / whole for s in order}
        above = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mixing(spark, docs, rows, none):
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words_of(t))
    target = brute_targets(sizes)
    source = {i: s for i, _, _, s, _ in rows}
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        rate = target[s] / sizes[s] if sizes[s] else 0
        assert r["taken"] in (r["size"] * int(rate), r["size"] * min(3, int(rate) + 1)) and r["taken"] <= 3 * r["size"]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixture(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.filter("size <> 'clash' OR copies <> 'clash'").count() == 0
    assert mixed.count() == mixing.copies(docs).agg(F.sum("copies")).first()[0]
    assert mixing.mixture(none).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000}, {"a": 1, "b": 1, None: 500, "z": 3}, {"a": 0, "b": 0}, {"only": 7}, {"a": 1, "b": 1, "c": 1, "d": 10**12}])
def test_targets_reach_their_level(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_taken_words_come_near_their_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(20, 60), "en", f"s{i % 4}", 1) for i in range(20_000)]
    got = mixing.mixture(spark.createDataFrame(rows, DOCS)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    # A thousand draws a source: within about four of their standard deviations.
    assert len(got) == 4 and all(r["taken"] == pytest.approx(r["target"], rel=0.2) for r in got)


@pytest.mark.parametrize("ids", ["each", "a third without", "all without", "one for all"])
def test_rows_without_an_id_are_drawn_one_by_one(spark, ids):
    """However ids are missing or repeated, a source's words come as near its target."""
    rng = random.Random(11)
    pick = {"each": lambda i: i, "a third without": lambda i: None if i % 3 == 0 else i, "all without": lambda i: None, "one for all": lambda i: 7}[ids]
    rows = [(pick(i), f"t{i} " + " ".join(["w"] * rng.randint(20, 60)), "en", f"s{i % 5}", 0) for i in range(20_000)]
    got = mixing.mixture(spark.createDataFrame(rows, DOCS)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 5 and all(abs(r["taken"] - r["target"]) <= 0.06 * r["target"] for r in got)


@pytest.mark.parametrize("pairs, block", [(1 << 12, 1024), (300, 1024), (300, 40)])
def test_crowded_segments_of_short_lines(spark, monkeypatch, pairs, block):
    """Lines of one site's addresses, a few of them alike: the groups are those of all pairs, however many share a segment."""
    monkeypatch.setattr(lines, "SHORT_PAIRS", pairs)
    monkeypatch.setattr(lines, "SHORT_BLOCK", block)
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [f"httpswww example org {letters(30)}" for _ in range(120)] + [letters(rng.randint(1, 70)) for _ in range(30)]
    for i in range(40):
        t = list(texts[i])
        for _ in range(rng.randint(1, 12)):
            t[rng.randrange(21, len(t))] = rng.choice("abc")
        texts.append("".join(t))
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "form bigint, short string")
    want = brute_components(range(len(texts)), lambda a, b: lines.similarity(texts[a], texts[b]) >= 0.8)
    linked = lines.short_links(df, 0.8)
    assert all(lines.similarity(texts[r["a"]], texts[r["b"]]) >= 0.8 for r in linked.collect())
    got = {r["node"]: r["label"] for r in connected_components(linked).collect()}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) < len(want)


def test_many_addresses_of_one_site_take_no_pairs(spark):
    """2,000 unlike lines that share half their segments with all others: no link, and no pair of them is a row."""
    rng = random.Random(9)
    rows = [(i, "httpswww example org " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30))) for i in range(2000)]
    linked = lines.short_links(spark.createDataFrame(rows, "form bigint, short string"), 0.8)
    assert linked.count() == 0
