"""The ten operators on small tables: against brute force, exact round trips or held-out rows; and on
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, more=""):
    """rows of (doc_id, text); the other columns are filled."""
    return spark.createDataFrame([(i, t, "en", "a.example.org", None if t is None else len(t)) + ((1, 2, 3) if more else ()) for i, t in rows], DOCS + more)


CLASHING = ", words string, p string, fp string"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, one word, a very long text, exact repeats of rows and of texts, near copies."""
    rng = random.Random(5)
    long = words(rng, 60_000, 5000)
    base = [words(rng, 60) for _ in range(12)]
    rows = [(None, "null id " + base[0]), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, long), (6, base[0]), (7, base[0]), (7, base[0])]
    rows += [(10 + i, b) for i, b in enumerate(base)]
    rows += [(40 + i, b.replace("w1", "x1", 1)) for i, b in enumerate(base)]
    rows += [(60, base[1] + " " + base[2]), (61, "é ü 漢字 𝄞 " + base[3]), (62, long[:200_000] + " end")]
    return rows


def test_simhash_against_brute_force(spark, odd):
    from marlstone.llm.simhash import deduplicate, near_groups

    import xxhash

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    got = near_groups(docs_of(spark, odd, ", fp string, words string, root string")).collect()
    assert len(got) == len(odd)
    want = {(i, fingerprint(t)) for i, t in odd}
    assert {(r["doc_id"], r["fp"] & (2**64 - 1)) for r in got} == want
    least = {}
    for f in {f for _, f in want}:
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for y in {f for _, f in want} - seen:
                if (x ^ y).bit_count() <= 4:
                    seen.add(y)
                    todo.append(y)
        least[f] = min((i for i, g in want if g in seen and i is not None), default=None)
    assert all(r["component_id"] == least[r["fp"] & (2**64 - 1)] for r in got)
    kept = deduplicate(docs_of(spark, odd, CLASHING), shingle=4)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({v for v in least.values() if v is not None}) and len(kept.columns) == 8
    assert near_groups(docs_of(spark, [])).count() == 0


def test_similar_against_brute_force(spark, odd):
    """Pairs at 0.8 and above are linked however far their fingerprints lie apart, none below."""
    from marlstone.llm.simhash import deduplicate_near

    rng = random.Random(8)
    rows = list(odd)
    for g in range(40):
        base = words(rng, 120, 3000).split()
        rows.append((1000 + 10 * g, " ".join(base)))
        for k in range(1, 5):
            edit = list(base)
            for _ in range(rng.randrange(1, 5)):
                edit[rng.randrange(len(edit))] = f"new{rng.randrange(10**6)}"
            rows.append((1000 + 10 * g + k, " ".join(edit)))
    rows += [(3000 + i, "a passage that very many documents hold at once " + words(rng, 30)) for i in range(60)]

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    group = list(range(len(rows)))
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if group[a] != group[b] and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for (i, _), g in zip(sets, group, strict=True):
        best[g] = min((i is None, i), best.get(g, (True, None)), key=lambda v: (v[0], v[1] or 0))
    got = deduplicate_near(docs_of(spark, rows, CLASHING))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == sorted((n, i or 0) for n, i in best.values()) and len(got.columns) == 8
    assert deduplicate_near(docs_of(spark, [])).count() == 0


def test_segment_counts_bound_the_difference():
    """The Manhattan distance of segment counts never exceeds the symmetric difference, whatever the sizes."""
    import numpy as np

    from marlstone.llm.similar import manhattan, segment_counts

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 60, 700, 9_000):
        for m in (1, 40, 5_000):
            a = rng.integers(0, 2**63, n, dtype=np.uint64) * 2
            b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, m, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            differ = len(np.setxor1d(a, b))
            assert manhattan(segment_counts(a), segment_counts(b)) <= differ
    same = np.unique(rng.integers(0, 2**20, 100_000, dtype=np.uint64))
    assert len(segment_counts(same)) == 0 and manhattan(segment_counts(same), segment_counts(a)) == 0


def test_near_dedup_tells_null_and_shared_ids_apart(spark):
    from marlstone.llm.simhash import deduplicate, deduplicate_near

    rng = random.Random(9)
    one, two, three, four = (words(rng, 80, 5000) for _ in range(4))
    rows = [(None, one), (None, two), (None, two), (None, None), (None, " "), (1, three), (5, three), (5, four)]
    for near in (deduplicate, deduplicate_near):
        got = [(r["doc_id"], (r["text"] or "").strip()) for r in near(docs_of(spark, rows, CLASHING)).collect()]
        assert sorted(got, key=str) == sorted([(None, one), (None, two), (None, ""), (1, three), (5, four)], key=str)


def test_simhash_large_cells_are_exact(spark):
    """The way for crowded cells finds the same components as comparing all."""
    from marlstone.llm.components import connected_components
    from marlstone.llm.simhash import fingerprint_links

    rng = random.Random(3)
    centre = rng.getrandbits(64)
    points = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")

    def parts(cell):
        out = {}
        for r in connected_components(fingerprint_links(df, cell_size=cell)).collect():
            out.setdefault(r["root"], set()).add(r["node"])
        return sorted(sorted(p) for p in out.values() if len(p) > 1)

    groups = {p: {p} for p in signed}
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for x in groups[b]:
                    groups[x] = groups[a]
    want = sorted(sorted(g) for g in {id(g): g for g in groups.values()}.values() if len(g) > 1)
    assert parts(16_384) == want and parts(4) == want


def test_components_of_long_chains(spark):
    from marlstone.llm.components import connected_components

    rng = random.Random(1)
    ids = rng.sample(range(10**9), 400)
    links = list(zip(ids, ids[1:], strict=False))
    del links[150]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame([*links, (7, 7), (None, 3)], "a long, b long")).collect()}
    assert len({got[i] for i in ids[:151]}) == 1 and len({got[i] for i in ids[151:]}) == 1 and got[ids[0]] != got[ids[-1]] and got[7] == 7


def test_substring_dedup_against_brute_force(spark, odd, monkeypatch):
    from marlstone.llm.substring_dedup import remove_repeats

    rng = random.Random(9)
    passage = words(rng, 20, 10**6)
    rows = odd + [(70 + i, f"{words(rng, 15)} {passage} {words(rng, 15)}") for i in range(30)]
    got = remove_repeats(docs_of(spark, rows, CLASHING)).collect()
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, w in split:
        gone = {p for k in range(len(w) - 12 if i is not None else 0) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert remove_repeats(docs_of(spark, [])).count() == 0
    # More groups and buckets than partitions give the same.
    from marlstone.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "GROUP", 500)
    monkeypatch.setattr(substring_dedup, "BUCKET", 3000)
    assert sorted(map(repr, map(tuple, remove_repeats(docs_of(spark, rows)).collect()))) == sorted(map(repr, want))


def test_substring_plan_splits_crowded_prefixes():
    from marlstone.llm.substring_dedup import CELLS, _plan

    first, span = _plan([(3, 10), (5, 1000), (9, 10), (2**CELLS - 1, 10)], 10)
    assert span[5] == 10 and first[3] < first[5] and first[9] == first[5] + span[5] and span[3] == span[9] == 1


def test_decontamination_against_brute_force(spark, odd):
    from marlstone.llm.decontaminate import contamination, decontaminate

    rng = random.Random(2)
    items = [(1, words(rng, 30, 10**6)), (20, words(rng, 10, 10**6)), (3, "Tiny Item é"), (4, None), (5, " .. "), (6, None)]
    items[5] = (6, items[0][1])
    rows = odd + [(80, f"A b. {items[0][1].upper()}! c"), (81, f"x {items[1][1]}, y TINY,item é z"), (82, " ".join(items[0][1].split()[:9])), (82, "other"), (83, items[0][1] + " " + items[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, t in rows:
        w, hit, owners = norm(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    owners |= windows[tuple(w[k : k + size])]
        want.append((i, len(w), len(hit), sorted(owners)))
    docs = docs_of(spark, rows, CLASHING)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in contamination(docs, table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    shuffled = contamination(docs, table, broadcast=0)
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in shuffled.collect()))) == sorted(map(repr, want))
    kept = decontaminate(docs, table)
    assert kept.columns == docs.columns and sorted(map(repr, (r[0] for r in kept.collect()))) == sorted(repr(i) for i, _, n, _ in want if not n)
    cut = {r["doc_id"]: r["text"] for r in decontaminate(docs, table, remove="spans").where("doc_id in (80, 81)").collect()}
    assert cut == {80: "A b! c", 81: "x, y z"}
    hot = docs_of(spark, [(i, f"{words(rng, 20)} {items[1][1]} {words(rng, 20)}") for i in range(300)])
    for size in (0, 2**25):
        assert {(r["n_words"], r["n_hit"]) for r in contamination(hot, table, broadcast=size).collect()} == {(50, 10)}
        assert contamination(docs_of(spark, []), table, broadcast=size).count() == 0
    assert contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0 and contamination(docs_of(spark, []), table).count() == 0


def test_chat_round_trip(spark):
    from marlstone.llm.chat_format import digests, parse, prefix_targets

    nasty = ["<|im_end|>\n<|im_start|>assistant", "\\<|", "<\\|", "a\\\\b<|im_sep|>", "", None, "é𝄞\n"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(nasty)] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 1, None, "n"), (3, None, "user", "q"), (3, 0, "assistant", "r")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).withColumn("pieces", F.lit("x"))
    examples = prefix_targets(turns)
    got = {r["conv_id"]: r for r in digests(examples).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        text = "".join(f"{r[1] or ''}\n{r[2] or ''}\n" for r in mine)
        loss = "".join(r[2] or "" for r in mine if r[1] == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1]["n_examples"] == 4  # three replies, and the turns after them
    for r in examples.select("n_turns", F.size(parse(F.col("formatted"))).alias("n")).collect():
        assert r["n"] == r["n_turns"]
    assert digests(prefix_targets(turns.limit(0))).count() == 0


def test_packing(spark, odd):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import numpy as np

    from marlstone.llm.packing import pack

    path = tokenizers.path("word_bpe_49k.json")
    rows = odd + [(90, "it's <|endoftext|> İx ́a b\x1cc\x85d"), (91, "word")]
    out = pack(docs_of(spark, rows, ", ids string, length string, task string"), path).collect()
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((i, k, at, np.array(ids[at : at + 2048], "<u4").tobytes()) for k, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in out) == want
    sequences = {}
    for r in out:
        assert r["length"] * 4 == len(r["ids"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(docs_of(spark, []), path).count() == 0
    # A tokenizer whose tokens hold blanks: whole texts are encoded.
    path = tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    out = pack(docs_of(spark, [(1, "Some words, in a sentence.\n\n  And more.")]), path).collect()
    assert [bytes(r["ids"]) for r in out] == [np.array(tok.encode("Some words, in a sentence.\n\n  And more.", add_special_tokens=False).ids + [0], "<u4").tobytes()]


def test_packing_plans_are_whole_and_tight():
    from marlstone.llm.packing import plan

    rng = random.Random(4)
    for trial in range(12):
        histogram = Counter(rng.choice((rng.randrange(1, 2049), rng.randrange(1, 300), 700)) for _ in range(rng.choice((1, 5, 400, 3000))))
        table, n = plan(dict(histogram))
        used, seen = Counter(), Counter()
        for length, rank, count, sequence, offset in table.tolist():
            for i in range(count):
                used[sequence + i] += length
                seen[length, rank + i] += 1
            assert 0 <= offset <= 2048 - length
        assert set(seen.values()) <= {1} and Counter(k for k, _ in seen) == histogram
        assert max(used.values()) <= 2048 and len(used) == n
        bound = max(math.ceil(sum(k * c for k, c in histogram.items()) / 2048), sum(c for k, c in histogram.items() if k > 1024))
        assert n <= bound * 1.12 + 2, (trial, n, bound)


def test_toxicity_learns_and_locates(spark):
    from marlstone.llm.toxicity import fit, score, train

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.25
        parts = [words(rng, 8) for _ in range(6)]
        if bad:
            parts[rng.randrange(6)] += rng.choice((" scoundrel", " rotters", " rotten"))
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(bad)))
    odd_rows = [(1000, None), (1001, ""), (1002, "..."), (1003, "word " * 50_000), (None, "You scoundrel")]
    docs = docs_of(spark, rows + odd_rows, ", score string, y string, id string")
    table = spark.createDataFrame([x for x in labels if zlib.crc32(str(x[0]).encode()) % 4 != 2] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score(docs, train(docs, table)).collect()}
    held = [(got[i]["score"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((s >= 0.3) == y for s, y in held) / len(held) > 0.97
    assert all(0 <= got[i]["score"] < 0.1 and got[i]["offending"] == [] for i in (1000, 1001, 1002))
    assert got[None]["score"] > 0.5
    for i, y in labels[:50]:
        if y and got[i]["offending"]:
            worst = got[i]["offending"][0]
            assert re.search("scoundrel|rotte", rows[i][1][worst["start"] : worst["end"]])
    # Training in executors is the same as in memory.
    known = {i: t for i, t in rows}
    mine, plain = train(docs, table), fit([(known[i], y) for i, y in sorted({r["doc_id"]: r["toxic"] for r in table.where("doc_id is not null and toxic is not null").collect()}.items())])
    assert mine.weights.keys() == plain.weights.keys() and plain.weights and abs(mine.bias - plain.bias) < 1e-6
    assert all(abs(mine.weights[k] - v) < 1e-6 for k, v in plain.weights.items())
    # Noisy-or of sentence scores, by hand.
    squash = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    from marlstone.llm.toxicity import _features

    for i, t in rows[:40]:
        p = [squash(mine.bias + sum(mine.weights.get(x, 0.0) for w in set(x.split()) for x in _features((w,)))) for x in t.lower().split(".") if x.strip()]
        assert abs(got[i]["score"] - (1 - math.prod(1 - min(x, 1 - 1e-9) for x in p))) < 1e-9
    assert train(docs, table.limit(0)).weights == {} and train(docs, table.withColumn("toxic", F.lit(0))).weights == {}
    assert score(docs.limit(0), fit([])).count() == 0 and fit([("a", 1)] * 5).weights == {}


def test_weighted_sampling(spark, odd):
    from marlstone.llm.weighted_sampling import edited_pairs, likeness

    rng = random.Random(6)
    rows = odd + [(i, words(rng, rng.randrange(1, 400), 150)) for i in range(200, 320)]
    got = edited_pairs(docs_of(spark, rows, ", run string, rank string, term string"))
    got = got.withColumn("a", likeness(F.col("own"), F.col("changed"))).withColumn("b", likeness(F.col("own"), F.col("following"))).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    weigh = lambda t: Counter(re.findall(r"[^\x20\x09-\x0D]+", t))
    true = lambda a, b: 1.0 if not a and not b else sum(min(a[x], b[x]) for x in a) / sum(max(a[x], b[x]) for x in a.keys() | b.keys())
    want, errors = Counter(), []
    by = {}
    for k, (i, t) in enumerate(ordered):
        after, n = ordered[(k + 1) % len(ordered)][1], len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
        by[i, t] = (true(weigh(t), weigh(edited)), true(weigh(t), weigh(after)), edited)
    assert Counter((r["doc_id"], r["n_chars"], r["edited"]) for r in got) == want
    texts = {i: t for i, t in ordered}
    for r in got:
        t = texts[r["doc_id"]]
        if (r["doc_id"], t) in by and r["doc_id"] not in (7,):
            errors += [r["a"] - by[r["doc_id"], t][0], r["b"] - by[r["doc_id"], t][1]]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.35
    same = {}
    for r in got:
        assert same.setdefault(texts[r["doc_id"]], r["own"]) == r["own"]
    assert edited_pairs(docs_of(spark, [])).count() == 0
    assert edited_pairs(docs_of(spark, [(5, "a b c d e f g h")])).first()["n_chars"] == 15


def test_weighted_sampling_runs(spark):
    """Any 64-bit ids: far ones, the ends of the range, a hot id, many nulls; runs stay of like size."""
    from marlstone.llm.weighted_sampling import _runs, edited_pairs

    cases = {
        "far": [*range(600), 2**62],
        "ends": [-(2**63), 2**63 - 1, *range(-300, 300)],
        "hot": [5] * 400 + list(range(200)),
        "nulls": [None] * 400 + list(range(200)),
        "one": [7],
    }
    for name, ids in cases.items():
        docs = spark.createDataFrame([(i, f"text {k} of its own") for k, i in enumerate(ids)], "doc_id long, text string")
        sizes = [r["count"] for r in _runs(docs).groupBy("run").count().collect()]
        assert sum(sizes) == len(ids) and max(sizes) <= max(4, 3 * len(ids) / len(sizes)) and len(sizes) > len(ids) / 60, (name, sorted(sizes))
        got = edited_pairs(docs).select("doc_id", "n_chars", "edited").collect()
        tie = {r[0]: r[1] for r in docs.select("text", F.xxhash64("text")).collect()}
        ordered = sorted(((i, f"text {k} of its own") for k, i in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
        want = Counter()
        for k, (i, t) in enumerate(ordered):
            cut = len(t) // 4
            want[i, len(t), hashlib.sha256((t[: len(t) - cut] + ordered[(k + 1) % len(ordered)][1][:cut]).encode()).hexdigest()] += 1
        assert Counter((r[0], r[1], r[2]) for r in got) == want, name


def test_weighted_samples_against_a_plain_sampler(spark):
    """Two texts agree on a sample exactly where a sampler in plain Python picks one term and step."""
    import struct

    import xxhash

    from marlstone.llm.weighted_sampling import PASS, SAMPLES, edited_pairs

    h = lambda raw, seed=42: xxhash.xxh64_intdigest(raw, seed)
    unit = lambda x, shift, bits: ((x >> shift & (1 << bits) - 1) + 0.5) * 2.0**-bits

    def samples(text):
        out = []
        counts = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
        for i in range(SAMPLES):
            best = None
            for word, w in counts.items():
                seed = h(struct.pack("<i", i // PASS), h(struct.pack("<Q", h(word.encode()))))
                x = h(struct.pack("<Q", seed ^ i % PASS))
                y = h(struct.pack("<Q", x))
                r, c = -math.log(unit(x, 0, 21) * unit(x, 21, 21)), -math.log(unit(y, 0, 32) * unit(y, 32, 32))
                t = math.floor(math.log(w) / r + unit(x, 42, 22))
                value = math.log(c) - r * (t - unit(x, 42, 22) + 1)
                best = min(best or (math.inf,), (value, word, t))
            out.append(best and best[1:])
        return out

    rng = random.Random(31)
    texts = {i: words(rng, rng.randrange(5, 60), 25) for i in range(30)}
    texts |= {30: "", 31: "one", 32: " one one ", 33: "\n", 34: words(rng, 4_000, 300)}
    docs = docs_of(spark, list(texts.items()))
    rows = edited_pairs(docs).collect()
    # Terms passed over never matter: not where nearly all documents are taken again, nor where none is passed over.
    for likely in (0.5, 3.0, 1e9):
        assert sorted(edited_pairs(docs, likely=likely).collect()) == sorted(rows), likely
    got = {r["doc_id"]: r["own"] for r in rows}
    want = {i: samples(t) for i, t in texts.items()}
    same = differ = 0
    for a in texts:
        for b in range(a):
            for k in range(SAMPLES):
                agree = want[a][k] == want[b][k]
                same += agree and got[a][k] != got[b][k]
                differ += not agree and got[a][k] == got[b][k]
    assert same == 0 and differ <= 5  # 16 bits of a hash may meet


def test_warc_round_trip(spark):
    from marlstone.llm.warc_zip import archive_folder, read_archives, write_archives

    html = ["<p>é</p>", "", None, "same", "same", "x" * 300_000, "same", "PK\x05\x06 \r\n\r\n"]
    rows = [(i, f"http://h/{i}\r\nx", h) for i, h in enumerate(html)] + [(6, "http://h/6", "same"), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x")).withColumn("payload", F.lit("y"))
    got = read_archives(write_archives(pages, archive_folder(spark))).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = i == top[h or ""] or i is None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""]))
    assert sorted(map(repr, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(repr, want))
    assert all(bytes(r["payload"]) == (html[r["page_id"]] or "").encode() for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    least = read_archives(write_archives(pages, archive_folder(spark), least_bytes=5)).where("record_type = 'revisit'")
    assert least.count() == 0
    assert read_archives(write_archives(pages.limit(0), archive_folder(spark))).count() == 0


def test_warc_archives_of_others(spark, tmp_path):
    """Members and indexes found by listing: gzipped and deflated indexes, none, incomplete ones, plain WARC files,
    names of other kinds; deflated archives and damaged records raise."""
    import gzip
    import io
    import json
    import zipfile

    from marlstone.llm.warc_zip import read_archives

    def warc(kind, name, body, more=""):
        block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + body if kind != "warcinfo" else body
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: http://x/{name}\r\n{more}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    made = [warc("warcinfo", "i", b"software: some"), warc("response", "a", b"<p>one</p>" * 9), warc("revisit", "b", b"", "WARC-Refers-To: <urn:uuid:a>\r\nWARC-Payload-Digest: sha1:ABC\r\n"), warc("response", "c", b"\r\n\r\n" * 400_000)]
    packed = [gzip.compress(x) for x in made]
    places = [(sum(map(len, packed[:k])), len(x)) for k, x in enumerate(packed)]
    line = lambda at, n: f"com,x)/ 2020 {json.dumps(dict(url='u', filename='rec-1.warc.gz', offset=str(at), length=n))}"
    index = "\n".join(line(*p) for p in places).encode()
    part = line(*places[1]).encode()
    files = {
        "gz": [("archive/rec-1.warc.gz", b"".join(packed), 0), ("indexes/index.cdx.gz", gzip.compress(index), 0), ("datapackage.json", b"{}", 8)],
        "packed": [("indexes/index.cdxj", index, 8), ("archive/rec-1.warc.gz", b"".join(packed), 0)],
        "none": [("archive/rec-1.warc.gz", b"".join(packed), 0)],
        "part": [("archive/rec-1.warc.gz", b"".join(packed), 0), ("indexes/index.cdx", part, 0)],
        "plain": [("archive/rec-1.warc", b"".join(made), 0)],
        "two": [("archive/rec-1.warc.gz", b"".join(packed[:2]), 0), ("archive/more/rec-2.warc", b"".join(made[2:]), 0)],
        "deflated": [("archive/rec-1.warc.gz", b"".join(packed), 8)],
        "damaged": [("archive/rec-1.warc", warc("response", "d", b"x", "WARC-Payload-Digest: sha1:" + "A" * 32 + "\r\n"), 0)],
    }
    for name, members in files.items():
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for at, data, method in members:
                z.writestr(zipfile.ZipInfo(at), data, method)
            z.comment = b"holds PK\x05\x06 and 20 bytes that are no directory"
        path = tmp_path / f"{name}.zip"
        path.write_bytes(raw.getvalue())
        out = read_archives(spark.createDataFrame([(f"file://{path}",)], "path string"))
        if name in ("deflated", "damaged"):
            with pytest.raises(Exception, match=f"is {name}"):
                out.collect()
            continue
        rows = {r["record_id"]: r for r in out.collect()}
        assert [rows[f"<urn:uuid:{k}>"]["record_type"] for k in "iabc"] == ["warcinfo", "response", "revisit", "response"] and len(rows) == 4
        assert bytes(rows["<urn:uuid:a>"]["payload"]) == b"<p>one</p>" * 9 and rows["<urn:uuid:c>"]["payload_bytes"] == 1_600_000
        b = rows["<urn:uuid:b>"]
        assert b["refers_to_id"] == "<urn:uuid:a>" and b["payload"] is None and b["payload_digest"] == "ABC" and b["page_id"] is None and b["url"] == "http://x/b"


def test_zip_directories():
    import io
    import zipfile

    from marlstone.llm.warc_zip import StoredZip, zip_stored

    members = [("a/b.txt", b"hello"), ("é.bin", bytes(range(256)) * 50), ("empty", b"")]
    for wide in (False, True):
        raw = zip_stored(members, zip64=wide)
        assert [(n, zipfile.ZipFile(io.BytesIO(raw)).read(n)) for n, _ in members] == members
        reads = []

        def fetch(at, n, raw=raw, reads=reads):
            reads.append(n)
            return raw[at : at + n]

        z = StoredZip(fetch, len(raw))
        assert [(n, z.read(n)) for n in z.members] == members and z.read("é.bin", 256, 3) == b"\x00\x01\x02"
        with pytest.raises(ValueError, match="no such range"):
            z.read("a/b.txt", 3, 5)
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.comment = b"a comment"
        z.writestr("stored", b"123")
        z.writestr(zipfile.ZipInfo("packed"), b"1" * 100, zipfile.ZIP_DEFLATED)
    raw = made.getvalue()
    z = StoredZip(lambda at, n: raw[at : at + n], len(raw))
    assert list(z.members) == ["stored"] and z.read("stored") == b"123" and z.read("packed") == b"1" * 100
    with pytest.raises(ValueError, match="is deflated"):
        z.read("packed", 0, 5)
    with pytest.raises(ValueError, match="not a ZIP"):
        StoredZip(lambda at, n: b"x" * n, 100)


def test_patience_blocks():
    from marlstone.llm.line_dedup import patience_blocks

    assert patience_blocks(list("abcde"), list("abxde")) == [(0, 0, 2), (3, 3, 2)]
    assert patience_blocks([], list("ab")) == [] and patience_blocks(list("xaby"), list("zabw")) == [(1, 1, 2)]
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(15))] for _ in "ab")
        last = (0, 0)
        for i, j, n in patience_blocks(a, b):
            assert a[i : i + n] == b[j : j + n] and i >= last[0] and j >= last[1] and n > 0
            last = i + n, j + n


def test_align_covers_all_that_is_shared():
    """Whatever two documents share is in a block, moved or repeated lines too; blocks are equal lines."""
    from marlstone.llm.line_dedup import align

    assert align([(0, 5, 1), (1, 6, 1), (2, 0, 1)]) == [(5, 0, 2), (0, 2, 1)]
    assert align([(0, 3, 1), (2, 3, 1)]) == [(3, 0, 1), (3, 2, 1)]
    rng = random.Random(1)
    for _ in range(300):
        first = [rng.randrange(12) for _ in range(rng.randrange(1, 15))]
        later = [rng.randrange(14) for _ in range(rng.randrange(1, 15))]
        shared = [(j, first.index(x), 1) for j, x in enumerate(later) if x in first]
        blocks = align(shared)
        covered = [j + k for _, j, n in blocks for k in range(n)]
        assert sorted(covered) == [j for j, _, _ in shared] and all(first[i + k] == later[j + k] for i, j, n in blocks for k in range(n))
    assert len(align([(i, 5000 - i, 1) for i in range(5000)])) == 5000  # all reversed: quadratic ways would not end


def _lines_brute(rows):
    """{row number: numbers of the lines that go}: common runs of lines, blank ones aside, of 20 characters or
    more with any earlier document, or equal documents; by comparing all pairs of documents."""
    blank = " \t\n\v\f\r"
    docs = [[(k, x.strip(blank)) for k, x in enumerate((t or "").split("\n")) if x.strip(blank)] for _, t in rows]
    out = {}
    for d, (i, t) in enumerate(rows):
        gone = set()
        for e, (k, _) in enumerate(rows):
            if i is None or k is None or not k < i:
                continue
            a, b = [x for _, x in docs[e]], [x for _, x in docs[d]]
            if a == b:
                gone |= set(range(len(b)))
                continue
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] != b[y] or (x and y and a[x - 1] == b[y - 1]):
                        continue
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    if sum(map(len, b[y : y + n])) >= 20:
                        gone |= set(range(y, y + n))
        lines = (t or "").split("\n")
        state = {docs[d][at][0]: at in gone for at in range(len(docs[d]))}
        side = lambda ks, state=state: next((state[k] for k in ks if k in state), True)
        out[d] = {k for k in range(len(lines)) if gone and (state[k] if k in state else side(range(k, -1, -1)) and side(range(k, len(lines))))}
    return out


def test_line_dedup_against_brute_force(spark):
    """Moved, repeated, short and blank lines, chains of holders, common lines: what all pairs say."""
    from marlstone.llm.line_dedup import common_blocks, deduplicate_lines, report

    rng = random.Random(11)
    pool = [f"this is a line of its own number {k}" for k in range(60)] + [f"s{k}" for k in range(10)] + ["", "  ", "medium line 1", "medium line 2", "a licence line that all hold", "漢字の行"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(150)]
    for _ in range(60):  # copies with lines moved, dropped or doubled
        lines = rng.choice(rows)[1].split("\n")
        at, to = rng.randrange(len(lines)), rng.randrange(len(lines) + 1)
        rows.append((200 + len(rows), "\n".join(rng.choice([lines[:at] + lines[at + 1 :], lines[to:] + lines[:to], lines + lines, lines]))))
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (903, "tiny"), (904, "tiny"), (905, "tiny\nmore"), (906, "你好世界\n再见"), (907, "你好世界\n再见"), (907, "你好世界\n再见")]
    rng.shuffle(rows)
    rows.append((990, "\n".join(pool * 400)))
    docs = docs_of(spark, rows, ", id string, key string, c1 string")
    gone = _lines_brute(rows[:-1]) | {len(rows) - 1: None}
    want = []
    for d, (i, t) in enumerate(rows[:-1]):
        lines = (t or "").split("\n")
        want.append((i, len(lines), len(gone[d]), "\n".join(x for k, x in enumerate(lines) if k not in gone[d]) if gone[d] else t or ""))
    got = [(r["doc_id"], r["n_lines"], r["n_removed"], r["kept"]) for r in report(docs).collect()]
    assert sorted(map(repr, (g for g in got if g[0] != 990))) == sorted(map(repr, want)) and len(got) == len(rows)
    kept = deduplicate_lines(docs)
    assert kept.columns == docs.columns
    stays = sorted(repr((i, k)) for i, _, n, k in got if not n or k.strip(" \t\n\v\f\r"))
    mine = kept.select("doc_id", "text", "n_chars").collect()
    assert sorted(repr((r[0], r[1] or "")) for r in mine) == stays and all(r[2] == (len(r[1]) if r[1] is not None else None) for r in mine)
    texts = dict(rows)
    for r in common_blocks(docs).collect():
        for b in r["blocks"]:
            full = [[x.strip() for x in texts[i].split("\n") if x.strip()] for i in (b["partner"], r["id"])]
            assert b["partner"] < r["id"] and full[0][b["partner_start"] :][: b["lines"]] == full[1][b["start"] :][: b["lines"]]
    assert report(docs_of(spark, [])).count() == 0 and deduplicate_lines(docs_of(spark, [])).count() == 0


def test_line_dedup_has_no_cliff(spark):
    """However many documents hold a block, all but the first lose it; hot units take the broadcast way."""
    from marlstone.llm.line_dedup import report

    line = lambda k: f"this is a line of its own number {k}"
    for holders in (2, 100, 101, 400):
        rows = [(i, f"{line(1)}\n{line(2)}\n{line(1000 + i)}") for i in range(holders)]
        got = report(docs_of(spark, rows)).collect()
        assert sum(r["n_removed"] for r in got) == 2 * (holders - 1)
        assert all(r["kept"] == line(1000 + r["doc_id"]) for r in got if r["doc_id"])
    rows = [(5, line(1) + "\n" + line(2)), (5, line(1) + "\n" + line(3)), (5, line(1) + "\n" + line(2))]  # texts that share an id
    got = sorted(r["kept"] for r in report(docs_of(spark, rows)).collect())
    assert got in ([line(1) + "\n" + line(2)] * 2 + [line(3)], [line(1) + "\n" + line(3), line(2), line(2)])


def test_language_id(spark):
    from marlstone.llm.language_id import document_rows, identify, keep_identified, page_rows, train

    rng = random.Random(7)
    sounds = {"aa": ["the", "ing", "tion", "wh", "er"], "bb": ["eau", "ou", "que", "é", "ai"]}
    make = lambda lang, n=30: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(l := "ab"[i % 2] * 2), l, f"host{i % 3}.example.org", 1) for i in range(200)]
    rows += [(300, None, "aa", None, 0), (301, "", None, "", 0), (302, "123 !!", "bb", "x", 0), (303, make("bb", 20_000), None, None, 1), (303, "more " + make("bb"), None, None, 1), (None, make("aa"), "aa", "h", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("best", F.lit("x")).withColumn("id", F.lit("y"))
    model = train(docs)
    out = identify(document_rows(docs), model).collect()
    assert len(out) == len(rows)
    got = {r["id"]: r for r in out}
    assert all(got[r[0]]["language"] == r[2] and got[r[0]]["confidence"] > 0.9 for r in rows[:200]) and got[303]["language"] == "bb" and got[None]["language"] == "aa"
    assert all(got[i]["rejected"] and got[i]["language"] is None for i in (300, 301, 302))
    kept = keep_identified(docs)
    assert kept.count() == len(rows) - 3 and kept.columns == docs.columns
    # Without telling letters the host's and the suffix's priors decide.
    pages = [(i, f"https://w{i % 2}.site.{'aa' if i % 2 else 'bb'}/x", f'<html lang="{"aa" if i % 2 else "bb"}"><p>{make("aa" if i % 2 else "bb")}</p>') for i in range(100)]
    pages += [(200, "https://w1.site.aa/y", "<p>zz</p>"), (201, "http://user@w0.site.bb:80/", "<HTML LANG='bb'>zz"), (202, None, None), (203, "nonsense", "<script>the</script>")]
    seen = {r["id"]: r for r in identify(page_rows(spark.createDataFrame(pages, "page_id long, url string, html string")), model).collect()}
    assert all(seen[i]["language"] == ("aa" if i % 2 else "bb") for i in range(100))
    assert seen[200]["language"] == "aa" and seen[201]["language"] == "bb" and seen[202]["rejected"] and seen[203]["rejected"]
    assert identify(document_rows(docs.limit(0)), model).count() == 0
    assert identify(document_rows(docs), train(docs.limit(0))).where("not rejected").count() == 0


def test_language_id_against_brute_force(spark):
    """The fused posterior, each row's own verdict left out, in plain Python; and languages held out of the fit."""
    from marlstone.llm import language_id as li

    rng = random.Random(21)
    sounds = {"aa": ["the", "ing", "tion", "wh"], "bb": ["eau", "ou", "que", "ai"], "rare": ["szcz", "rzy", "ąc", "ów"]}
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(2)) for _ in range(n))
    rows = [(i, make(lang := "rare" if i % 100 == 7 else "ab"[i % 2] * 2, rng.randrange(1, 12)), lang, f"h{i % 5}.site{i % 2}.org", 0) for i in range(400)]
    rows += [(1000 + i, make("aa", 3), None, "one.host", 0) for i in range(3)] + [(2000, "zz", None, None, 0), (2001, "", "aa", "h1.site1.org", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = li.train(docs.where("doc_id % 4 <> 2"), sample=100)
    assert model[0] == ["aa", "bb", "rare"]
    inputs = li.document_rows(docs, declared="lang").withColumn("suffix", F.substring_index("host", ".", -1))
    got = {r["id"]: r for r in li.identify(inputs, model).collect()}
    held = [got[i]["language"] == lang for i, t, lang, _, _ in rows if lang and i % 4 == 2 and len(t) > 20]
    assert len(held) > 50 and sum(held) / len(held) > 0.97

    cells, n = li._trigram_cells(), 3
    facts = []
    for i, t, lang, host, _ in rows:
        at = cells(t)
        fits = model[1][at].sum(axis=0) / max(1, len(at)) * min(len(at), li.TRIGRAMS)
        facts.append((i, len(at), fits, int(fits.argmax()) if len(at) else None, lang, host and ".".join(host.split(".")[-2:]), host, host and host.split(".")[-1]))
    total = [sum(f[3] == k for f in facts) for k in range(n)]
    whole = [(k + 1) / (sum(total) + n) for k in total]

    def smooth(column, me, above):
        mine = [0.0] * n
        if facts[me][column] is not None:
            for k, f in enumerate(facts):
                if k != me and f[3] is not None and f[column] == facts[me][column]:
                    mine[f[3]] += 1
        return [(x + li.WEIGHT * p) / (sum(mine) + li.WEIGHT) for x, p in zip(mine, above, strict=True)]

    for me, f in enumerate(facts):
        if not f[1]:
            assert got[f[0]]["rejected"]
            continue
        prior = smooth(6, me, smooth(5, me, whole))
        e = [f[2][k] + math.log(prior[k]) + sum(math.log(smooth(c, me, whole)[k] / whole[k]) for c in (4, 7)) for k in range(n)]
        weight = [math.exp(x - max(e)) for x in e]
        assert abs(got[f[0]]["confidence"] - max(weight) / sum(weight)) < 1e-4 and got[f[0]]["language"] == model[0][e.index(max(e))]


def test_language_id_query_fuses_all_evidence(spark, tmp_path):
    """The query weighs declared language and address suffix, and no row's label supports its own text."""
    import numpy as np

    from marlstone.llm import language_id as li
    from marlstone.llm.queries import op4_language_id

    rng = random.Random(5)
    sounds = {"aa": ["the", "ing", "tion"], "bb": ["eau", "ou", "que"]}
    make = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(2)) for _ in range(12))
    rows = [(i, make(lang := "bb" if i % 3 == 0 else "aa"), lang, f"h{i % 4}.site.{lang}", 0) for i in range(300)]
    # Equal texts, told apart by the declared language alone, or by the suffix of unknown hosts.
    rows += [(1000, "zz", "bb", None, 0), (1001, "zz", "aa", None, 0), (1002, "xx", None, "new.other.BB", 0), (1003, "xx", None, "new.others.aa", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["language"] for r in op4_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(got[r[0]] == r[2] for r in rows[:300])
    assert (got[1000], got[1001]) == ("bb", "aa")
    assert (got[1002], got[1003]) == ("bb", "aa")

    names, tables = li.train(docs, folds=2)
    for fold in range(2):
        alone = li.train(docs.where(li.fold_of(F.col("doc_id"), 2) != fold))
        assert alone[0] == names and np.allclose(alone[1], tables[fold])


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(12)
    clean = [(i, "\n".join(words(rng, 25, 5000) for _ in range(5))) for i in range(60)]
    item = words(rng, 15, 10**6)
    rows = clean + [(100 + i, t) for i, t in clean[:10]] + [(200, "x " + item + " y"), (201, "12 34"), (202, None)]
    folder = str(tmp_path)
    docs_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in docs.collect()})
    ids = {i for i, _ in clean}
    assert left[0] == ids | {100 + i for i in range(10)} | {200} and left[1] == ids | {200} and left[2] == ids | {200} and left[3] == ids
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.collect()} == ids


def test_pipeline_of_odd_tables(spark, tmp_path):
    """The whole run: an empty table; nulls, repeated rows, shared and null ids, a long text, columns with clashing names."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    extra = {c: F.lit(7) for c in ("h", "key", "__key", "__id", "word", "sequence_id", "piece", "root", "b", "a.b")}
    rng = random.Random(41)
    text = lambda n=60: "\n".join(words(rng, 12, 5000) for _ in range(n // 12))
    clean = [(i, text()) for i in range(40)]
    odd = [clean[3]] * 3 + [(5, text()), (None, text()), (None, None), (50, ""), (51, None), (52, " \n\t"), (53, text(30_000))]
    for name, rows, items in (("empty", [], []), ("odd", clean + odd, [(None, None), (1, ""), (2, words(rng, 12, 10**6))])):
        folder = str(tmp_path / name)
        docs_of(spark, rows).withColumns(extra).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == columns
        got = out.collect()
        if not rows:
            assert got == []
            continue
        firsts = Counter(r["doc_id"] for r in got if r["piece"] == 0)
        assert firsts == Counter({**dict.fromkeys([i for i, _ in clean], 1), 5: 2, None: 1, 53: 1})
        long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 53)
        assert len(long) > 10 and [s for _, s, _ in long] == [2048 * p for p, _, _ in long] and {n for _, _, n in long[:-1]} == {2048}
        held = {}
        for r in got:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in held.values():
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
            assert sum(n for _, n in parts) <= 2048
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:  # by itself, with and without the clashing names
            with_, without = stage(spark, docs, folder), stage(spark, docs.drop(*extra), folder)
            keys = ["doc_id", "piece", "start", "length"] if "piece" in without.columns else without.columns
            assert with_.columns == without.columns
            assert Counter(with_.select(keys).collect()) == Counter(without.select(keys).collect())
