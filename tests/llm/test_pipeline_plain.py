"""run() from end to end against a plain version of every stage."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
import pytest

from proofloom.llm import registry, simhash

PASSAGE = "a passage that several documents share word for word and that is long enough to be found again by its bytes"

WORD = "[^\x20\x09-\x0d]+"


def plain_near_copies(rows):
    sets = {i: set(simhash.shingles(t.encode(), 5)) for i, t, _ in rows}
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    return [r for r in rows if not any(i < r[0] and similar(sets[i], sets[r[0]]) for i, _, _ in rows)]


def plain_cut(rows):
    first = {}
    for i, t, _ in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    out = []
    for i, t, s in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out.append((i, bytes(c for c, g in zip(b, gone) if not g).decode(errors="ignore"), s))
    return out


def plain_mix(rows):
    size = {i: len(re.findall(WORD, t)) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows})
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    whole = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    left, open_, target = 1.5 * sum(whole.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * whole[s]}
        target |= {s: 2.0 * whole[s] for s in over} or {s: level * weight[s] for s in open_}
        if not over:
            break
        left -= sum(2.0 * whole[s] for s in over)
        open_ -= over
    copies = Counter()
    for s in sources:
        demand = math.floor(target[s] + 1e-9)
        passes, before = demand // whole[s] if whole[s] else 0, 0
        own = sorted((hashlib.md5(f"{i} {t}".encode()).hexdigest(), i, t) for i, t, x in rows if x == s)
        for _, i, t in own:
            taken = passes * size[i] + max(0, min(size[i], demand - passes * whole[s] - before))
            before += size[i]
            while taken > 0:
                words = min(size[i], taken)
                parts = re.split(r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", t)
                copies[i, t if words == size[i] else "".join(parts[:words])] += 1
                taken -= words
    return copies


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = " ".join(f"w{k}" for k in range(120))
    rows = [
        (1, f"First words. {PASSAGE}", "s1"), (2, f"{PASSAGE} and other ones after it", "s2"), (3, base, "s1"), (4, base.replace("w60", "changed"), "s2"), (5, base, "s3"),
        (6, "Ünï straße " * 30, "s3"), (7, "short", "s1"), (8, f"once more {PASSAGE} with an end of its own", "s3"), (9, " ".join(f"v{k * 7}" for k in range(300)), "s2"),
    ]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_run_equals_plain_stages(spark, folder):
    from tokenizers import Tokenizer

    path, rows = folder  # all labels are good, so the first stage keeps all
    known = Tokenizer.from_file(registry.TOKENIZER)
    known.no_truncation()
    known.no_padding()
    kept = plain_near_copies(rows)
    assert {i for i, _, _ in kept} == {1, 2, 3, 6, 7, 8, 9}
    want = Counter()
    for (i, text), n in plain_mix(plain_cut(kept)).items():
        ids = known.encode(text, add_special_tokens=False).ids
        want[i, len(ids), tuple(ids), known.decode(ids, skip_special_tokens=False)] += n
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, path).collect())
    assert got == want
