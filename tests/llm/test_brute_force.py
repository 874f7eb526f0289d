"""Every corpus operator against a plain version on small tables with nulls, empties, ties and clashing columns."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from proofloom.llm import bpe, exact, language, licenses, media, mixing, quality, registry, simhash, suffixes, toxicity

TOKENIZER = registry.TOKENIZER
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "a passage that several documents share word for word and that is long enough to be found again by its bytes "
TEXTS = [
    (1, f"first {PASSAGE} and an end", "en", "s1"),
    (2, "", "en", "s1"),
    (3, None, None, None),
    (4, f"another {PASSAGE} Straße Ünï ñandú", "de", "s2"),
    (5, f"first {PASSAGE} and an end", "en", "s1"),
    (6, "x", "fr", "s2"),
    (7, "MIT License and the GNU General Public License, Apache License 2.0 apply here", "en", None),
    (8, "word " * 3000 + "tail", "es", "s1"),
    (9, "one two", "en", "s3"),
    (10, "<|endoftext|> İstanbul ΑΣ 日本語 é 1 2 3 don't", "en", "s3"),
    (11, "first  A PASSAGE\tthat several documents share word for word and that is long enough to be found again by its bytes and an end", "en", "s3"),
    (None, "a document without an id", "en", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_base_license_phrases(docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    found = by_id(licenses.report(docs))
    for i, text, *_ in TEXTS:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
        places = [(k, k + len(p.split()) - 1, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        got = found[i]
        assert (got["n_words"], got["n_base"]) == (len(words), len(places))
        assert got["base_labels"] == ",".join(sorted({p[2] for p in places}))
        assert set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(","))
        assert 0 <= got["score"] <= 1
    assert {"mit", "gpl", "apache"} <= set(found[7]["labels"].split(","))


def test_mixing_meets_targets_and_is_stable(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    sizes, taken, targets = {}, {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        targets[r["source"]] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        over = [s for s in open_ if (left - sum(full.values())) * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]]
        if not over:
            break
        full |= {s: 2.0 * sizes[s] for s in over}
    want = {s: full.get(s, (left - sum(full.values())) * weight[s] / sum(weight[x] for x in open_)) for s in order}
    for s in order:
        assert targets[s] == pytest.approx(want[s], rel=1e-9)
        assert taken[s] == math.floor(targets[s] + 1e-9) or abs(taken[s] - targets[s]) <= 1
    again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(docs).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in rows)


def test_curriculum_takes_the_words(docs):
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    got = {}
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(re.findall("[^\x20\x09-\x0d]+", r["text"]))
    assert got == {s: n for s, n in taken.items() if n}


def test_position_inverts_the_schedule(spark):
    for (start, end), turn in zip(mixing.SCHEDULES, range(3)):
        rows = spark.range(11).select((F.col("id") / 10.0).alias("u")).withColumn("t", mixing.position(F.lit(turn), F.col("u"))).collect()
        for r in rows:
            assert start * r["t"] + (end - start) * r["t"] ** 2 / 2 == pytest.approx(r["u"], abs=1e-9)


def plain_removals(rows):
    first, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 2000, "bucket_bytes": 3000, "hot_docs": 1}, {"block_bytes": 500, "bucket_bytes": 200, "hot_docs": 3}])
def test_suffix_removals(docs, settings):
    known = docs.filter("doc_id is not null")
    got = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixes.removals(known.select("doc_id", "text"), **settings).collect()}
    assert got == plain_removals([(i, t) for i, t, *_ in TEXTS if i is not None])


def test_suffix_texts_keep_whole_characters_and_columns(docs):
    odd = docs.withColumns({"spans": F.lit("mine"), "kept": F.lit(3), "block": F.lit("b")})
    out = suffixes.deduplicate(odd)
    assert out.columns == odd.columns
    for r in out.collect():
        assert (r["spans"], r["kept"], r["block"]) == ("mine", 3, "b")
        assert r["n_chars"] == len(r["text"])


def test_exact_fingerprints(docs):
    rows = sorted((i, t or "") for i, t, *_ in TEXTS if i is not None)
    got = by_id(exact.fingerprints(docs))
    assert len(got) == len(TEXTS)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert got[1]["fingerprint"] == got[5]["fingerprint"] == got[11]["fingerprint"] != got[4]["fingerprint"]
    assert got[2]["fingerprint"] == got[3]["fingerprint"] and got[2]["near_next"] == 1.0


def test_tokens_match_the_library(docs):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(TOKENIZER)
    known.no_truncation()
    known.no_padding()
    got = by_id(bpe.encode_decode(docs, TOKENIZER))
    for i, text, *_ in TEXTS:
        ids = known.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["decoded"] == known.decode(ids, skip_special_tokens=False)


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [simhash.SHARD, 2])
def test_simhash_components(spark, hot):
    base = "the quick brown fox jumps over the lazy dog near the river bank while birds sing above and clouds move slowly to the east"
    words = base.split()
    texts = [(k, " ".join(words[:k] + ["changed"] + words[k + 1 :])) for k in range(20)] + [(50, base), (51, base * 40), (52, base * 40 + " x"), (60, ""), (61, None), (62, "a"), (63, "a b")]
    rows = [(i, plain_fingerprint(t)) for i, t in texts]
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.classes(df, hot).collect()}
    assert got == {i: (fp, label[i]) for i, fp in rows}
    kept = simhash.deduplicate(df.withColumn("extra", F.lit(1)), hot)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({label[i] for i, _ in rows})


def plain_links(points, radius):
    return {(min(a, b), max(a, b)) for a in points for b in points if a != b and (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("half", [*simhash.HALVES, simhash.WHOLE])
def test_vantage_trees_lose_no_neighbour(half):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(c) ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))}) for c in centres for _ in range(12)]
    tight = [1 << i | 1 << j for i in range(20) for j in range(i)]  # hardly anything splits these
    points = np.array(sorted({*near, *tight, 0}), np.uint64)
    pairs = {(int(points[i]), int(points[j])) for a, b in simhash.near_pairs(points, half) for i, j in zip(a, b)}
    want = plain_links([int(p) for p in points], 3)
    ours = {(min(p), max(p)) for p in pairs}
    in_half = {(a, b) for a, b in want if ((a ^ b) & half).bit_count() <= (1 if half != simhash.WHOLE else 3)}
    assert in_half <= ours <= want


def test_shards_overlap_at_boundaries():
    """Neighbours meet in a shard of one of the two trees, however the trees are grown."""
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [int(c) ^ sum({1 << int(b) for b in rng.integers(0, 64, 3)}) for c in centres]
    points = np.array(sorted({*near, *map(int, centres)}), np.uint64)
    met = set()
    for half in simhash.HALVES:
        tree = simhash.grow(rng.permutation(points)[:200], half, 8)
        assert tree.shards > 8
        seen = np.zeros(len(points), int)
        for _, own in tree.route(points):
            seen[own] += 1
            met |= plain_links([int(p) for p in points[own]], 3)
        assert seen.min() >= 1
    assert met == plain_links([int(p) for p in points], 3)


def test_simhash_keeps_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (2, "quite another text of words"), (None, "no id at all in this row")], "doc_id long, text string")
    assert simhash.deduplicate(df).count() == 3


def test_media_round_trip(docs):
    got = by_id(media.digests(docs))
    for i, text, *_ in TEXTS:
        data = (text or "").encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["media_bytes"] > len(padded)
    assert got[1]["media_sha256"] == got[5]["media_sha256"] and got[1]["feature"] == got[5]["feature"]


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [
        licenses.report(empty), mixing.mix(empty), mixing.curriculum(empty), toxicity.detect(empty, labels), language.identify(empty), suffixes.digests(empty), suffixes.deduplicate(empty),
        exact.fingerprints(empty), quality.classify(empty, labels), bpe.digests(empty, TOKENIZER), simhash.near_duplicates(empty), simhash.deduplicate(empty), media.digests(empty),
    ]
    for df in results:
        assert df.count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    """A very long text, ties, repeats and nulls, under extra columns that operators name themselves."""
    rows = [(1, "MIT License and words " * 20000), (2, "x" * 300_000), (3, None), (4, ""), (4, ""), (None, "no id"), (5, "MIT License and words " * 20000)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("mine") for c in ("n_words", "detections", "fp", "label", "size", "taken", "position", "media", "payload", "tracks", "n_bytes", "spans", "kept", "ids", "decoded", "fingerprint", "id", "next", "digest")})


def test_odd_rows_and_clashing_columns(odd):
    reports = [licenses.report(odd), exact.fingerprints(odd), media.digests(odd), mixing.mix(odd), suffixes.digests(odd), bpe.digests(odd, TOKENIZER), simhash.near_duplicates(odd)]
    for df in reports:
        rows = df.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "2", "3", "4", "4", "None", "5"])
        same = [tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "row_key", "before", "taken", "position", "near_next", "edited_sha256", "edited_fingerprint", "near_edited", "n_removed", "n_spans", "kept_sha256")) for r in rows if r["doc_id"] in (1, 5)]
        assert same[0] == same[1]
    for df in (suffixes.deduplicate(odd), simhash.deduplicate(odd), mixing.curriculum(odd)):
        assert df.columns == odd.columns
        assert all(r["fp"] == r["kept"] == "mine" for r in df.collect())


def test_media_of_several_tracks():
    """An audio track before a video track: each keeps its own tables."""
    one, two = media.pad(b"sound " * 300), media.pad(b"picture " * 200)
    head = media.box(b"ftyp", b"isom")

    def movie(first, second):
        parts = []
        for payload, at, codec in ((one, first, b"raw "), (two, second, b"avc1")):
            inner = media._movie(len(payload) // 64, at)
            trak = next(inner[body - 8 : stop] for kind, body, stop in media.boxes(inner, 8, len(inner)) if kind == b"trak")
            parts.append(trak.replace(b"raw ", codec))
        return media.box(b"moov", *parts)

    start = len(head) + len(movie(0, 0)) + 8
    data = head + movie(start, start + len(one)) + media.box(b"mdat", one, two)
    found = media.tracks(data)
    assert [t["codec"] for t in found] == ["raw", "avc1"]
    assert [media.payload_of(data, t) for t in found] == [one, two]
    assert found[1]["keyframes"][0].tolist() == [start + len(one), start + len(one) + 64]
    with pytest.raises(ValueError, match="fragmented"):
        media.tracks(head + media.box(b"moof"))
