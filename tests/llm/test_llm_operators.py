"""Operators on corpora against brute force, and their edge cases."""

import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import decontaminate, dedup_lines, dedup_spans, language, media, pieces, quality, simhash, token_store, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[i * i % 20] + str(i % 97) for i in range(30_000))
PASSAGE = "One fox ran over the hill. Two dogs slept under a tree. Three cats sat on the red mat. " "Four birds sang all morning long. Five fish swam in the cold clear river today."
LINES = "first shared line here\nsecond shared line here\nthird shared line here"

#: Nulls, empty and blank texts, ties, repeated rows and ids, a very long text, other scripts.
TEXTS = [
    (1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (3, None), (4, ""), (5, " \t\n "),
    (6, LONG), (7, LONG + " end"), (8, "Ünïcode ÀÉ 日本語 😀 text\nwith lines\n\nand blanks "), (9, PASSAGE), (10, "Start here now. " + PASSAGE + " And so on."),
    (11, "x\n" + LINES + "\ny"), (12, LINES), (13, "two\n" + LINES), (None, "no id at all"), (14, "one"),
]


def frame(spark, rows=TEXTS):
    # Extra columns whose names could clash with internal ones.
    extra = "doc_id long, text string, lang string, source string, n_chars long, key string, hash long, __w string, at int, h1 long, fp string"
    full = [(i, t, "en", "s", None if t is None else len(t), "k", 1, "w", 0, 2, "f") for i, t in rows]
    return spark.createDataFrame(full, extra)


def documents(spark, rows=TEXTS):
    return frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")


def counted(rows):
    return sorted(map(repr, rows))


# ---- simhash


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_groups(ids, fps, most=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        known = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(known) if known else None
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_on_edge_cases(spark):
    got = simhash.near_duplicates(frame(spark)).select("doc_id", "fingerprint", "component_id").collect()
    fps = [slow_fingerprint(t) for _, t in TEXTS]
    groups = slow_groups([i for i, _ in TEXTS], fps)
    assert counted(tuple(r) for r in got) == counted((i, f"{f:016x}", g) for (i, _), f, g in zip(TEXTS, fps, groups))


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 20])
def test_simhash_links_near_random_fingerprints(spark, chunk):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = list(base)
    for b in base[:20]:
        for bits in (1, 3, 4, 5, 6):
            fps.append(b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, bits, replace=False).astype(np.uint64)))
    for _ in range(40):  # a dense group around one centre
        fps.append(base[0] ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 2, replace=False).astype(np.uint64)))
    fps = sorted({int(f) for f in fps})
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, chunk=chunk)).collect()}
    want = slow_groups(fps, fps)
    got = {}
    for f, w in zip(fps, want):
        signed = int(np.uint64(f).view(np.int64))
        got.setdefault(roots.get(signed, signed), set()).add(w)
    assert all(len(g) == 1 for g in got.values()) and len(got) == len(set(want))


@pytest.mark.parametrize("most", [1, 2, 3, 4, 5, 7])
def test_near_fingerprints_share_a_point(most):
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, flips = rng.integers(0, 2**64, dtype=np.uint64), rng.choice(64, most, replace=False).astype(np.uint64)
        b = a ^ np.bitwise_or.reduce(np.uint64(1) << flips)
        points, owner = simhash.grid_points(np.array([a, b], np.uint64), most)
        assert set(points[owner == 0]) & set(points[owner == 1])


def test_random_fingerprints_hardly_meet():
    points, _ = simhash.grid_points(np.random.default_rng(3).integers(0, 2**64, 100_000, dtype=np.uint64))
    assert len(points) - len(np.unique(points)) < 1000


def test_hot_points_are_dealt_to_chunks(spark):
    # All share 43 bits, so one point holds every one of them.
    rng = np.random.default_rng(4)
    rest = [sum(1 << int(b) for b in rng.choice(21, 6, replace=False)) for _ in range(3000)]
    fps = sorted({(5 << 40) + r for r in rest})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = [{r["node"]: r["root"] for r in simhash.components(simhash.links(table, 2, chunk)).collect()} for chunk in (100, 10**6)]
    for f in fps:
        group = [{g for g in fps if r.get(g, g) == r.get(f, f)} for r in roots]
        assert group[0] == group[1]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 50)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(1000, 1050)}) == 1 and got[0] != got[1000]


def _near_texts(rng, sizes, copies=6):
    """Texts of the given numbers of words, and copies of each with a few words changed, cut or added."""
    out = []
    for size in sizes:
        words = [f"w{rng.integers(10**6)}" for _ in range(size)]
        out.append(" ".join(words))
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.integers(1, max(2, size // 30))):
                own[rng.integers(len(own))] = f"x{rng.integers(10**6)}"
            cut = int(rng.integers(0, 1 + size // 12))
            out.append(" ".join(own[cut:] if rng.random() < 0.5 else own + [f"y{k}" for k in range(cut)]))
    return out


def _similar_components(texts):
    """Brute force: the least index that each text is linked to, by exact sets of word tuples."""
    sets = [{w[k : k + 5] for k in range(len(w) - 4)} if len(w) > 5 else {w} if w else set() for w in (tuple((t or "").split()) for t in texts)]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if root[i] != root[j] and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_similar_documents_against_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = _near_texts(rng, [8, 12, 20, 33, 40, 60, 61, 90, 150, 400, 401, 2000])
    texts += [None, "", " \t", "a", "a", "b c d e f", texts[7], texts[0] + "\n"] + [f"lone{k} " * 9 for k in range(5)]
    order = rng.permutation(len(texts))
    table = spark.createDataFrame([(int(i), texts[i], k) for k, i in enumerate(order)], "doc_id long, text string, a int").repartition(5)
    want = _similar_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table).collect()}
    assert got == dict(enumerate(want))
    assert len(set(want)) < 0.6 * len(want)
    kept = sorted(r["doc_id"] for r in simhash.first_of_each_group(table).collect())
    assert kept == sorted(set(want))


def test_similar_sets_share_a_point():
    rng = np.random.default_rng(12)
    shared = tried = 0
    for m in [*range(4, 60), 100, 257, 1000, 5000]:
        for _ in range(20):
            union = rng.integers(0, 2**64, m, dtype=np.uint64)
            differ = m // 5  # a similarity of 0.8 or just more, dealt to either side
            cut = int(rng.integers(differ + 1))
            a, b = np.sort(union[cut:]), np.sort(np.delete(union, np.s_[cut:differ]))
            assert simhash.similarity(a, b) >= 0.8
            tried += 1
            shared += len(np.intersect1d(simhash.set_points(a), simhash.set_points(b))) > 0
    assert shared >= tried - 2
    far = [simhash.set_points(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(300)]
    assert len(np.unique(np.concatenate(far))) == sum(map(len, far))


def test_similar_documents_meet_by_fingerprints():
    """Each part of a set has a SimHash fingerprint, and parts with equal fingerprints meet, whatever their hashes are."""
    rng = np.random.default_rng(13)
    sets = [np.sort(rng.integers(0, 2**64, m, dtype=np.uint64)) for m in (0, 1, 3, 4, 9, 33, 300)]
    for hashes, starts, names in map(simhash.set_parts, sets):
        parts = np.split(hashes, starts)[1:]
        want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in part) > len(part)) for part in parts]
        assert simhash.part_fingerprints(hashes, starts).tolist() == want and len(names) == len(parts)
    text = "One two three  four five six seven"
    hashes, starts, _ = simhash.set_parts(simhash.shingle_set(text))
    assert set(simhash.part_fingerprints(hashes, starts).tolist()) == {simhash.fingerprint(text, simhash.SET_SHINGLE)}
    for _ in range(100):
        a, b, c, other = rng.integers(0, 2**64, 4, dtype=np.uint64)
        d = c ^ (~(a ^ b) & np.uint64(0xFFFF))  # where a and b agree, the third hash decides nothing
        points = [set(simhash.set_points(np.sort(np.array([a, b, x], np.uint64)))) for x in (c, d, other)]
        assert points[0] == points[1] and not points[0] & points[2]


def test_sets_of_a_batch_are_made_in_slices():
    """Of a batch of 5,000 texts a worker holds the sets of a slice at a time."""
    texts = [" ".join(f"w{k}x{i}" for i in range(150)) for k in range(5000)]
    keys = pa.array([{"doc_id": k, "text_hash": k} for k in range(5000)], pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64())]))
    batch = pa.RecordBatch.from_pydict({"key": keys, "text": pa.array(texts)})
    n, tracemalloc_was = 0, tracemalloc.is_tracing()
    tracemalloc.start()
    for out in simhash.marked_sets(iter([batch])):
        assert out["key"].to_pylist() == [{"doc_id": k, "text_hash": k} for k in range(n, n + len(out))]
        assert out["points"][0].as_py() == simhash.set_points(simhash.shingle_set(texts[n])).tolist()
        n += len(out)
    most = tracemalloc.get_traced_memory()[1]
    if not tracemalloc_was:
        tracemalloc.stop()
    assert n == 5000 and most < 15e6  # 33e6 if the whole batch is one slice


def test_similar_documents_of_one_large_group(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:60] + [f"own{k}"] + base[61:])) for k in range(400)] + [(7, "another text of this id")]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 401 and sorted({r["component_id"] for r in got}) == [0, 7]
    kept = simhash.first_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [rows[0], (7, "another text of this id")]


def test_near_copies_of_template_pages_are_all_linked(spark):
    """Pages of 69 common words and 9 own ones, each with one near copy: at points of more sets than `FEW` no link is lost."""
    rng = np.random.default_rng(21)
    common, rows = [f"c{k}" for k in range(69)], []
    for k in range(150):
        own = [f"o{k}x{i}" for i in range(9)]
        page = common[:40] + own + common[40:]
        copy = list(page)
        copy[int(rng.integers(10, 30))] = f"z{k}"
        copy[-1] = f"y{k}"
        rows += [(2 * k, " ".join(page)), (2 * k + 1, " ".join(copy))]
    assert simhash.similarity(*map(simhash.shingle_set, (rows[0][1], rows[1][1]))) >= 0.8
    assert simhash.similarity(*map(simhash.shingle_set, (rows[0][1], rows[2][1]))) < 0.8
    want = dict(enumerate(_similar_components([t for _, t in rows])))
    for chunk in (simhash.CHUNK, 100):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table, chunk=chunk).collect()}
        assert got == want == {k: k - k % 2 for k in range(300)}


def test_one_row_of_each_group_stays(spark):
    rows = simhash.first_of_each_group(documents(spark)).collect()
    ids = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert ids.count(2) == 0 and 1 in ids and 3 in ids and 4 not in ids and len(ids) == len(set(ids))
    # A doc_id with several texts is several documents: only the one that resembles an earlier one goes.
    text = " ".join(f"w{k}" for k in range(40))
    mixed = documents(spark, [(1, text), (2, text + " more"), (2, "other words entirely here now"), (2, "other words entirely here now"), (None, text[:-4])])
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in simhash.first_of_each_group(mixed).collect()))) == sorted(
        map(repr, [(None, text[:-4]), (2, "other words entirely here now")])
    )
    none = documents(spark, [])
    assert simhash.first_of_each_group(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    assert language.identify(none, language.learn(documents(spark))).count() == 0


def test_quality_keeps_a_column_of_its_own_name(spark):
    docs = documents(spark).withColumn("quality_score", F.lit(7.5)).withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (6, 1), (9, 0)], "doc_id long, quality int")
    kept = quality.accepted(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert [r[0] for r in kept.select("quality_score").distinct().collect()] == [7.5]


# ---- spans


def slow_spans(rows, min_words=dedup_spans.MIN_WORDS):
    """Sentences that any later run of two or more sentences covers, every run of up to 30 (longer ones consist of such) looked at."""
    seen, found = set(), {}
    for i, t in sorted(rows):
        words, ends = dedup_spans.sentences(t or "")
        starts = [0, *ends]
        for a in range(len(ends)):
            for b in range(a + 1, min(len(ends), a + 30)):
                run = tuple(tuple(words[starts[k] : ends[k]]) for k in range(a, b + 1))
                if ends[b] - starts[a] >= min_words:
                    if run in seen:
                        found.setdefault(i, set()).update(range(a, b + 1))
                    seen.add(run)
    return found


def removed_sentences(cleaned):
    got = {}
    for r in cleaned.select("doc_id", F.explode("removed").alias("r")).select("doc_id", "r.*").collect():
        got.setdefault(r["doc_id"], set()).update(range(r["first_sentence"], r["last_sentence"] + 1))
    return got


def slow_sentences(text):
    """Ends of sentences, each window of words looked at by itself."""
    words, ends = [], set()
    for line in text.lower().split("\n"):
        sentence = []
        for k, w in enumerate(line.split()):
            words.append(w)
            sentence.append(zlib.crc32(w.encode()))
            if w[-1] in ".!?" or k == len(line.split()) - 1:
                ends.add(len(words))
                if len(sentence) > dedup_spans.LONG_SENTENCE:
                    for a in range(len(sentence) - dedup_spans.CUT_WINDOW + 1):
                        window = sentence[a : a + dedup_spans.CUT_WINDOW]
                        last = max(b for b, h in enumerate(window) if h == min(window))
                        ends.add(len(words) - len(sentence) + a + last + 1)
                sentence = []
    return words, sorted(ends)


def test_sentences_against_a_slow_cutter():
    rng = np.random.default_rng(12)
    texts = [t for _, t in TEXTS if t] + ["\n".join(" ".join(rng.choice(WORDS, rng.integers(0, 50))) + rng.choice([".", "", "!"]) for _ in range(6)) for _ in range(200)]
    for t in texts:
        assert dedup_spans.sentences(t) == slow_sentences(t)


def test_spans_against_brute_force(spark):
    rows = [r for r in TEXTS if r[0] is not None and r[0] != 2]
    got = removed_sentences(dedup_spans.dedup_spans(frame(spark, rows)))
    assert got == slow_spans(rows) and {10, 7} <= set(got) and 9 not in got


def test_spans_of_every_length_against_brute_force(spark):
    rng = np.random.default_rng(21)
    pool = [" ".join(f"{WORDS[k % 20]}{k}x{m}" for m in range(n)) + "." for k, n in enumerate(rng.integers(1, 13, 24))]
    rows = [(i, " ".join(rng.choice(pool, rng.integers(0, 14)))) for i in range(150)]
    # Documents that share whole runs, cut off anywhere and within other text.
    for i in range(150, 300):
        source = rows[rng.integers(0, 150)][1].split(". ")
        a, b = sorted(rng.integers(0, len(source) + 1, 2))
        rows.append((i, f"own{i} " * int(rng.integers(0, 5)) + "start. " + " ".join(x.rstrip(".") + "." for x in source[a:b]) + f" end{i}."))
    got = removed_sentences(dedup_spans.dedup_spans(frame(spark, rows)))
    assert got == slow_spans(rows) and len(got) > 50


def test_the_tail_of_a_repeated_run_goes(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(n)) + "." for x, n in (("a", 11), ("b", 11), ("c", 5)))
    rows = [(1, f"One. {a} {b} {c} Other words follow here."), (2, f"Two. {a} {b} {c} Nothing like that.")]
    got = {r["doc_id"]: r["text"] for r in dedup_spans.dedup_spans(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "Two. Nothing like that."}


def test_spans_cleaned_texts_and_edge_cases(spark):
    rows = {(r["doc_id"], r["text"]): r for r in dedup_spans.dedup_spans(frame(spark)).collect()}
    assert (9, PASSAGE) in rows and (3, None) in rows and (4, "") in rows
    cleaned = next(r for r in rows.values() if r["doc_id"] == 10)
    assert cleaned["n_removed_words"] >= 20 and "Two dogs" not in cleaned["text"] and cleaned["text"].startswith("Start here now.")
    assert dedup_spans.dedup_spans(frame(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [10**8, 0])
def test_spans_of_rows_that_share_an_id(spark, broadcast_bytes):
    rows = [(None, "One. " + PASSAGE), (None, PASSAGE + " Two."), (5, PASSAGE + " Three here."), (5, PASSAGE + " Three here."), (5, "Four. " + PASSAGE)]
    got = [(r["doc_id"], r["n_removed_words"] > 0, len(r["removed"])) for r in dedup_spans.dedup_spans(frame(spark, rows), broadcast_bytes=broadcast_bytes).collect()]
    assert sum(x[1] for x in got if x[0] is None) == 1 and sum(x[1] for x in got if x[0] == 5) == 3
    own = [(5, PASSAGE + " Three here."), (5, PASSAGE + " Three here."), (5, "Four. " + PASSAGE)]
    assert len({(r["text"], r["n_removed_words"] > 0) for r in dedup_spans.dedup_spans(frame(spark, own)).collect()}) == 2


def test_passage_within_other_text_is_found(spark):
    passage = " ".join(f"{WORDS[k % 20]}{k}" for k in range(55))
    rows = [(1, "some words before it " + passage + " and others after"), (2, "quite another beginning " + passage + " ends so"), (3, "nothing of it")]
    assert set(removed_sentences(dedup_spans.dedup_spans(frame(spark, rows)))) == {2}


def test_any_passage_of_51_words_holds_a_common_span():
    rng = np.random.default_rng(11)

    def prose(n, stops):
        return [f"{w:x}" + ("." if stop else "") for w, stop in zip(rng.integers(1 << 60, size=n), rng.random(n) < stops)]

    for stops in (0, 0.02, 0.05, 0.1, 0.2):
        for _ in range(800):
            passage, outside = prose(51, stops), rng.choice([0, 0.05, 0.2], 2)
            texts = [" ".join([*prose(rng.integers(0, 40), x), *passage, *prose(rng.integers(0, 40), x)]) for x in outside]
            a, b = ({x[-1] for x in dedup_spans.spans(t)} for t in texts)
            assert a & b, texts


def test_lines_of_repeated_words_have_spans(spark):
    for period in (1, 2, 5, 17):
        line = " ".join(f"v{k % period}" for k in range(60))
        a, b = ({x[-1] for x in dedup_spans.spans(t)} for t in ("one two three " + line + " four", "five " + line + " six seven"))
        assert a & b, period
    rows = [(1, "other words here " + "same " * 60), (2, "and then " + "same " * 60 + "the end")]
    got = {r["doc_id"]: r["n_removed_words"] for r in dedup_spans.dedup_spans(frame(spark, rows)).collect()}
    assert got[2] >= 40


# ---- lines


def slow_lines(rows, least=3):
    seen, out = set(), []
    keyed = {}
    for i, t in rows:
        keyed[(i is not None, i or 0, t or "")] = (i, t)
    for _, (i, t) in sorted(keyed.items()):
        lines = (t or "").split("\n")
        part = [(k, x.rstrip(" ")) for k, x in enumerate(lines) if x.rstrip(" ")]
        gone = set()
        for s in range(len(part) - least + 1):
            run = tuple(x for _, x in part[s : s + least])
            if run in seen:
                gone |= {k for k, _ in part[s : s + least]}
            seen.add(run)
        out.append((i, t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(part), len(gone)))
    return out


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [r for r in TEXTS if r[0] != 2] + [(100 + k, "\n".join(rng.choice(list("abcd"), rng.integers(0, 14)))) for k in range(40)]
    for broadcast_bytes in (10**8, 0):
        got = dedup_lines.dedup_lines(frame(spark, rows), broadcast_bytes=broadcast_bytes)
        got = got.select("doc_id", "text", "n_lines", "n_deleted").collect()
        assert counted(tuple(r) for r in got) == counted(slow_lines(rows))


def slow_runs(rows, least=3, min_words=20):
    """Every run of up to `least` lines that counts is looked up among all earlier ones."""
    seen, gone_of = set(), {}
    for i, t in sorted(rows):
        part = [(k, x.rstrip(" ")) for k, x in enumerate(t.split("\n")) if x.rstrip(" ")]
        gone = set()
        for s in range(len(part)):
            for e in range(s + 1, min(s + least, len(part)) + 1):
                run = tuple(x for _, x in part[s:e])
                if e - s == least or sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone |= {k for k, _ in part[s:e]}
                    seen.add(run)
        gone_of[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)
    return gone_of


def test_short_runs_of_many_words_go(spark):
    rng = np.random.default_rng(8)
    lines = [" ".join(rng.choice(WORDS, n)) for n in (1, 2, 9, 10, 11, 12, 19, 20, 21, 60)]
    rows = [(k, "\n".join(rng.choice(lines, rng.integers(1, 9)))) for k in range(60)]
    rows += [(100, lines[9] + " x"), (101, "  " + lines[9] + " x"), (102, lines[9] + " x  "), (103, "new\n\n" + lines[9] + " x\nend"), (104, "")]
    got = dedup_lines.dedup_lines(frame(spark, rows), min_words=20).collect()
    assert {r["doc_id"]: (r["text"], r["n_deleted"]) for r in got} == slow_runs(rows)
    by_id = {r["doc_id"]: r["text"] for r in got}
    assert by_id[102] == "" and by_id[103] == "new\n\nend" and by_id[101] != ""


def test_lines_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, LINES), (1, LINES), (2, LINES)]
    got = dedup_lines.dedup_lines(frame(spark, rows)).select("doc_id", "n_deleted").collect()
    assert counted(tuple(r) for r in got) == counted([(1, 0), (1, 0), (2, 3)])
    assert dedup_lines.dedup_lines(frame(spark, [])).count() == 0


# ---- decontamination


def slow_hits(rows, items, width=10):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), tuple(sorted(map(str, found)))))
    return out


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_decontamination_against_brute_force(spark, broadcast_rows):
    items = [(1, "A b, C d e f g h i j k l"), (2, "one"), (3, None), (4, "..."), (5, "two dogs slept"), (6, "b c d e f g h i j k"), (60, " ".join(LONG.split()[100:150]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = TEXTS + [(None, "a b c d e f g h i j k l"), (None, "two dogs slept"), (2, "one by one"), (50, "dogs, slept")]
    docs = frame(spark, texts)
    got = decontaminate.decontaminate(docs, bench, broadcast_rows=broadcast_rows, broadcast_bytes=broadcast_rows * 100)
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()]
    assert counted(rows) == counted(slow_hits(texts, items))
    assert set(docs.columns) <= set(got.columns)


def test_decontamination_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(documents(spark), none).where("contaminated").count() == 0
    assert decontaminate.decontaminate(documents(spark, []), none).count() == 0
    assert decontaminate.clean_documents(documents(spark), none).count() == len(TEXTS)


# ---- pieces


def sentencepiece_of(kind):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\na", "a\n b", " \n ", "▁x", "é日本𠮷", "\t\ta", "x" * 300, "😀😀 ok", "a\r\nb", "llll rrrr", "▁▁ ▁", LONG[:3000]]


def test_kind_is_read_from_the_model_file():
    model = sentencepiece_of("bpe").serialized_model_proto()
    assert pieces.kind_of(model) == "bpe" and pieces.kind_of(b"") == pieces.kind_of(b"\x12\x02\x18\x01") == "unigram"
    with pytest.raises(ValueError):
        pieces.kind_of(b"\x12\x02\x18\x03")


def test_pieces_equal_the_library(spark):
    library, own = sentencepiece_of("bpe"), pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    letters = list("abcdefghinorstuTHE éè日,.!\n\t▁😀0123lr")
    texts = ODD + ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t).tolist() == ids, t
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids), t


def test_unigram_viterbi_is_the_best_segmentation():
    own = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), "unigram")
    for word in ["▁the", "▁hello", "internation", "rrr", "ation"]:
        best = [0.0] + [-np.inf] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                i = own.piece_of.get(word[s:e])
                if i is not None:
                    best[e] = max(best[e], best[s] + own.scores[i])
        assert sum(own.scores[i] for i in own._known(word)) == best[-1]


def test_pieces_of_edge_cases(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.encoded_documents(frame(spark), path).collect()
    assert len(got) == len(TEXTS) and all(r["round_trip"] for r in got)
    assert all(r["ids"] == [] for r in got if r["doc_id"] in (3, 4))
    both = pieces.decode_ids(pieces.encode_texts(documents(spark), path), path)
    assert both.where(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert pieces.encoded_documents(frame(spark, []), path).count() == 0


# ---- quality


def test_quality_learns_and_scores_everything(spark):
    rng = np.random.default_rng(11)
    good = [(i, " ".join(rng.choice(WORDS, 60)) + ".") for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in rng.choice(WORDS, 60))) for i in range(80)]
    docs = documents(spark, good + bad + [(5000, None), (5001, ""), (None, "no id"), (5002, LONG)])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(7, 1), (None, 0), (8, None)], "doc_id long, quality int")
    machine = quality.learn(docs, labels)
    scored = {r["doc_id"]: r["quality_score"] for r in quality.with_scores(docs, machine).collect()}
    assert len(scored) == 284 and all(0 <= s <= 1 for s in scored.values())
    held = [i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(scored[i] >= quality.THRESHOLD) == (i < 1000) for i in held]) > 0.95
    again = quality.learn(docs, labels)
    assert np.array_equal(machine.weights, again.weights)
    assert quality.with_scores(docs, quality.learn(docs, labels.limit(0))).where("quality_score <> 0.5").count() == 0


def test_quality_of_the_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    found = quality.op5_quality(spark, folder).join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    assert len(found) > 20 and (found["predicted"] == found["quality"]).mean() > 0.9


def test_repeated_rows_are_learnt_from_once(spark):
    docs = documents(spark, [(i, f"word{i % 9} other words") for i in range(40)] + [(1, "zzz")] * 30)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = documents(spark, [(i, f"word{i % 9} other words") for i in range(40)])
    assert np.array_equal(quality.learn(docs, labels).weights, quality.learn(once, labels).weights)


def test_machine_scores_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=40), rng.normal(size=(40, quality.FACTORS)), np.zeros(quality.STATS), np.ones(quality.STATS))
    places, x = np.array([0, 3, 17, 30]), np.array([1.0, -2.0, 0.5, 3.0])
    slow = m.bias + m.weights[places] @ x + sum(m.factors[places[i]] @ m.factors[places[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.raw_score(places, x) == pytest.approx(slow)


# ---- media


def test_media_against_plain_hashing(spark):
    docs = frame(spark)
    texts = TEXTS + [(70, "<p>a & b</p> &amp; &lt\n<img src='x'>\n\n  c \x00 d\r\ne"), (71, "&"), (72, "\n\nx")]
    docs = frame(spark, texts)
    found = media.resolve(media.parse_pages(media.document_pages(docs)), media.media_features(media.with_media(docs))).collect()
    assert len(found) == len(texts)
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        lines = [" ".join(x.split()) for x in (t or "").split("\n")]
        parts = ["Document", *filter(None, lines)]
        sequence = (1 + bool(lines[0]), f"Text of {len(raw)} bytes", len(parts) + 1, hashlib.sha256("\n".join(parts).encode()).hexdigest())
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), *sequence))
    columns = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 position caption n_segments texts_sha256".split()
    assert counted(tuple(r[c] for c in columns) for r in found) == counted(want)
    none = frame(spark, [])
    assert media.resolve(media.parse_pages(media.document_pages(none)), media.media_features(media.with_media(none))).count() == 0


def test_interleaved_sequences_against_plain_parsing(spark):
    docs = frame(spark)
    found = media.interleaved(media.parse_pages(media.document_pages(docs)), media.with_media(docs)).collect()
    want = []
    for i, t in TEXTS:
        raw = (t or "").encode()
        lines = [" ".join(x.split()) for x in (t or "").split("\n")]
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        blob = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        parts = [("text", x, None, None) for x in ["Document", *filter(None, lines)]]
        parts.insert(1 + bool(lines[0]), ("media", None, f"Text of {len(raw)} bytes", blob))
        want += [(i, k, *part) for k, part in enumerate(parts)]
    assert counted((r["doc_id"], r["position"], r["kind"], r["text"], r["caption"], r["media"] and bytes(r["media"])) for r in found) == counted(want)


def test_interleaved_edge_cases(spark, sf_dir):
    html = '<p>one</p><img src="sha256:aa"><p>two</p><img src="sha256:bb" alt="b"><img src="http://x/y.png">'
    pages = media.parse_pages(spark.createDataFrame([(1, html), (2, None), (3, "")], "doc_id long, html string"))
    blobs = spark.createDataFrame([("aa", b"A"), ("aa", b"A"), (None, b"C")], "digest string, media binary")
    rows = media.interleaved(pages, blobs).orderBy("doc_id", "position").collect()
    assert [(r["position"], r["kind"], r["text"], r["digest"], r["media"] and bytes(r["media"])) for r in rows] == [
        (0, "text", "one", None, None), (1, "media", None, "aa", b"A"), (2, "text", "two", None, None), (3, "media", None, "bb", None),
        (4, "media", "http://x/y.png", None, None),
    ]
    assert media.interleaved(pages.limit(0), blobs.limit(0)).count() == 0
    given = media.parse_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    n = given.selectExpr("sum(size(segments))").first()[0]
    assert media.interleaved(given, blobs, "page_id").count() == n


def test_segments_of_the_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = media.parse_pages(pages).collect()
    assert len(rows) == pages.count() and any(len(r["segments"]) > 3 for r in rows)
    for r in rows:
        assert [s["position"] for s in r["segments"]] == list(range(len(r["segments"])))


def test_segments_keep_order_and_captions(spark):
    html = '<p>One <b>two</b></p><figure><img src="sha256:ab" data-bytes="5"><figcaption>A &amp; b</figcaption></figure><script>x</script>three<img src="http://x/y.png" alt="alt">'
    kinds = [(s["position"], s["kind"], s["text"], s["digest"], s["caption"]) for s in media.segments_of(html)]
    assert kinds == [(0, "text", "One two", None, None), (1, "media", None, "ab", "A & b"), (2, "text", "three", None, None), (3, "media", "http://x/y.png", None, "alt")]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>un<closed")], "doc_id long, html string")
    parsed = media.parse_pages(pages)
    none = spark.createDataFrame([], "digest string, payload_bytes long")
    assert media.resolve(parsed, none).where("payload_bytes is null").count() == 2


# ---- language


def test_language_of_planted_texts(spark):
    rng = np.random.default_rng(5)
    kinds = {"aa": ["the", "and", "with", "from"], "bb": ["der", "und", "mit", "von"]}
    rows = [(i, " ".join(rng.choice(kinds[lang], 40)), lang) for i in range(120) for lang in [list(kinds)[i % 2]]]
    edge = [(900, None, None), (901, "", "aa"), (902, "12 345 !!", "bb"), (904, "½ ² ③ Ⅷ _", "bb"), (905, "12 ª", None), (None, "the and with", "bb"), (903, LONG, None)]
    docs = spark.createDataFrame(rows + edge, "doc_id long, text string, lang string")
    model = language.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert all(got[i][0] == lang and 0.5 < got[i][1] <= 1 for i, _, lang in rows)
    assert got[900] == got[901] == got[902] == got[904] == ("und", 0.0) and got[None][0] == "aa" and got[905][0] in ("aa", "bb")
    assert language.identify(docs, language.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("block", [language.BLOCK, 1])
def test_code_lengths_against_a_slow_coder(spark, monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    texts = {"x": "abracadabra abracadabra", "y": "barbara barb é", "z": "dada"}
    docs = spark.createDataFrame([(i, t, lang) for i in range(3) for lang, t in texts.items()], "doc_id long, text string, lang string")
    models = language.build(language.count_grams(docs.select("lang", "text")).toPandas())
    counts = {lang: {} for lang in texts}
    for lang, t in texts.items():
        raw = list(language.PAD + t.encode())
        for i in range(3, len(raw)):
            for k in range(4):
                here = counts[lang].setdefault(tuple(raw[i - k : i]), {})
                here[raw[i]] = here.get(raw[i], 0) + 3

    def bits(lang, context, s):
        while context and context not in counts[lang]:
            context = context[1:]
        here = counts[lang][context]
        total, distinct = sum(here.values()), len(here)
        if s in here:
            return -np.log2(here[s] / (total + distinct))
        escape = -np.log2(distinct / (total + distinct))
        return escape + (bits(lang, context[1:], s) if context else 8.0)

    probe = "abra zcad\né barb ß"
    raw = list(language.PAD + probe.encode())
    want = [sum(bits(lang, tuple(raw[i - 3 : i]), raw[i]) for i in range(3, len(raw))) for lang in texts]
    assert language.code_lengths(models, [probe])[0] == pytest.approx(want, rel=1e-5)


def test_language_of_the_given_documents(spark, sf_dir):
    found = language.op7_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.where("held_out and lang is not null").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.95


# ---- token store


def test_codes_give_random_access():
    rng = np.random.default_rng(6)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 49408, 3000), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    packed = token_store.Segment(token_store.pack(ids))
    assert packed.n == len(ids) and all(packed[i] == ids[i] for i in [*range(0, len(ids), 37), *range(6000, len(ids))])
    for a, b in [(0, len(ids)), (5, 5), (511, 513), (1000, 4000), (len(ids) - 1, len(ids))]:
        assert packed.slice(a, b).tolist() == ids[a:b].tolist()
    assert token_store.Segment(token_store.pack(np.zeros(0, np.uint32))).slice(0, 0).tolist() == []


def test_token_store_against_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = TEXTS + [(20 + k, t) for k, t in enumerate(["ΑΣ İstanbul", "a\x1cb", "<|endoftext|> x", "é é", "NBSP\xa0here", "'S don't 3a4"])]
    target = token_store.scratch_path(spark, "test-tokens")
    token_store.write_tokens(frame(spark, rows), target, path, segment_tokens=50_000)
    got = [tuple(r) for r in token_store.read_documents(spark, target).collect()]
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert counted(got) == counted(want)


def test_token_store_of_an_empty_table(spark):
    target = token_store.scratch_path(spark, "test-tokens")
    token_store.write_tokens(frame(spark, []), target, public_tokenizers.path("word_bpe_49k.json"))
    assert token_store.read_documents(spark, target).count() == 0


# ---- WARC


def captures(spark, rows):
    full = [(i, k, u, a, s, h, 3, "d" + str(i)) for i, k, u, a, s, h in rows]
    table = spark.createDataFrame(full, "record_id long, kind string, uri string, at long, status int, headers map<string,string>, n_bytes long, payload_sha256 string")
    return table.withColumn("url", warc.canonical_url(F.col("uri")))


def test_revisits_find_the_latest_earlier_response(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(300):
        hot = rng.random() < 0.5
        url = "http://www.Hot.example/a/" if hot else f"https://h{rng.integers(0, 20)}.example:443/p?utm_source=x&b=2&a=1#f"
        kind = "response" if rng.random() < 0.3 else "revisit"
        rows.append((k, kind, url, int(rng.integers(0, 100)), 200 if kind == "response" else 304, {"etag": '"e"'}))
    got = {r["record_id"]: (r["status"], r["response_id"]) for r in warc.resolve_revisits(captures(spark, rows)).collect()}

    def key(url):
        return "hot.example/a" if "Hot" in url else re.search(r"h\d+", url)[0]

    for i, kind, url, at, _, _ in rows:
        if kind == "revisit":
            earlier = [(a, j) for j, k, u, a, _, _ in rows if k == "response" and key(u) == key(url) and a < at]
            assert got[i] == (("resolved", max(earlier)[1]) if earlier else ("no_response", None))


def test_validators_and_headers(spark):
    rows = [
        (1, "response", "http://a/", 1, 200, {"etag": '"x"', "content-type": "t", "server": "s", "last-modified": "d"}),
        (2, "revisit", "http://a", 2, 304, {"etag": 'W/"x"', "content-type": "other", "date": "now"}),
        (3, "revisit", "http://a", 2, 304, {"etag": '"y"', "last-modified": "d"}),
        (4, "revisit", "http://a", 2, 304, {"last-modified": "d"}),
        (5, "revisit", "http://a", 2, 304, {}),
        (6, "revisit", "http://a", 1, 304, {"etag": '"x"'}),
        (7, "response", "http://a/", 2, 404, {}),
        (8, "revisit", None, 2, 304, {"etag": '"x"'}),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(captures(spark, rows)).collect()}
    assert {i: r["status"] for i, r in got.items()} == {2: "resolved", 3: "validator_mismatch", 4: "resolved", 5: "no_validator", 6: "no_response", 8: "no_response"}
    assert got[2]["headers"] == {"etag": 'W/"x"', "content-type": "t", "server": "s", "last-modified": "d", "date": "now"}
    assert warc.resolve_revisits(captures(spark, [])).count() == 0


def test_repeated_captures_and_nulls(spark):
    rows = [(1, "response", "http://a/", 1, 200, {"etag": '"x"'})] * 3 + [(2, "revisit", "http://a", 5, 304, {"etag": '"x"'})] * 3
    rows += [(9, "response", "http://a/", 1, 200, {"etag": '"y"'}), (3, "revisit", "http://a", None, 304, {"etag": '"x"'}), (4, "response", "http://a", None, 200, {"etag": '"x"'})]
    rows += [(None, "revisit", "http://a", 5, 304, None), (8, "response", "http://b", 3, 200, None), (7, "revisit", "http://b", 4, 304, {})]
    got = [(r["record_id"], r["status"], r["response_id"]) for r in warc.resolve_revisits(captures(spark, rows)).collect()]
    assert counted(got) == counted([(2, "validator_mismatch", None)] * 3 + [(3, "no_response", None), (None, "no_validator", None), (7, "no_validator", None)])


def test_records_round_trip(spark):
    pages = spark.createDataFrame([(0, "http://a/", "<p>x</p>\r\n\r\nWARC/1.1\r\n"), (1, "http://b/?q", "é" * 50_000), (3, "http://c", "")], "page_id long, url string, html string")
    found = warc.read_captures(warc.page_captures(pages))
    got = {r["record_id"]: (r["kind"], r["n_bytes"], r["payload_sha256"]) for r in found.collect()}
    assert len(got) == 6
    for r in pages.collect():
        body = r["html"].encode()
        assert got[f"{r['page_id']}/response"] == ("response", len(body), hashlib.sha256(body).hexdigest())


def test_damaged_records_are_skipped_and_counted(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}/", "<p>page</p>") for k in (1, 2, 3)], "page_id long, url string, html string")
    a, b, c = (bytes(r["warc"]) for r in warc.page_captures(pages).orderBy("warc").collect())
    kinds = lambda blob: [(h["warc-type"], len(body)) for h, _, _, body in warc.parse_warc(blob)]
    whole = [("response", 11), ("revisit", 0)]
    assert kinds(a + b) == whole * 2 and kinds(b"") == [] and kinds(b"junk") == [("damaged", 4)]
    assert kinds(a + b"junk\r\n" + c) == whole + [("damaged", 6)] + whole
    broken = b.replace(b"Content-Length: ", b"Content-Length: x", 1)
    assert kinds(a + broken + c)[2][0] == "damaged" and kinds(a + broken + c)[3:] == [("revisit", 0)] + whole
    cut = a[:-60]
    assert kinds(cut + c)[:2] == [("response", 11), ("damaged", len(a) - 60 - a.index(b"WARC/1.1", 5))] and kinds(cut + c)[2:] == whole
    files = spark.createDataFrame([(bytearray(a + broken),), (None,)], "warc binary")
    got = counted((r["kind"], r["record_id"]) for r in warc.read_captures(files).collect())
    assert got == counted([("response", "1/response"), ("revisit", "1/revisit"), ("damaged", None), ("revisit", "2/revisit")])


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_op10_on_odd_pages_equals_its_sql(spark, tmp_path, zone):
    import duckdb

    rows = [(k, f"http://www.H{k % 7}.example/p?b=2&utm_source=x&a={k % 3}#f", f"<p>{k}</p>" * (k % 5)) for k in range(60)]
    rows += [(12, "http://h/", "x")] * 3 + [(None, "http://h/", "x"), (61, None, "y"), (62, "http://h/", None), (None, None, None), (63, "", ""), (2**62, "http://h/", "z"), (-3, "http://h/", "w")]
    rows += [(12, "http://h/", "other"), (13, "no url at all", "z"), (64, "http://h/", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = warc.op10_warc(spark, str(tmp_path))
        got, columns = found.collect(), found.columns
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc.OP10_SQL).project(", ".join(columns)).fetchall()
    assert len(got) == len(rows) and counted(tuple(r) for r in got) == counted(want)
    empty = pages.limit(0)
    assert warc.resolve_revisits(warc.read_captures(warc.page_captures(empty))).count() == 0
