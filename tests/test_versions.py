"""Version processing: the stream with a restart, the fold of the whole log, and a plain loop agree."""

import hashlib
import random

import pytest

from proofloom.streaming import versions

LOG = [
    (1, "upload", "a", 1, 10, "one text", None), (2, "upload", "a", 2, 20, "one text", None), (3, "upload", "b", 3, 30, "one text", None), (4, "upload", "a", 4, 40, None, "broken"),
    (5, "upload", "a", 5, 50, " \n", None), (6, "retry", "a", 2, 20, "one text", None), (7, "retry", "a", 4, 40, "mended", None), (8, "reference", "a", 4, 40, None, None),
    (9, "retry", "a", 4, 40, "changed", None), (10, "retry", "b", 3, 30, None, None), (11, "retry", "a", 9, 90, "x", None), (12, "upload", "a", 6, 60, None, "broken"), (13, "upload", "a", 7, 70, None, "broken"),
]

WANTED = {
    10: ("processed", None, 1, 0, "one text"), 20: ("duplicate", None, 0, 0, None), 30: ("failed", "unreadable", 2, 0, None), 40: ("processed", None, 2, 1, "mended"),
    50: ("failed", "blank_text", 1, 0, None), 60: ("failed", "broken", 1, 0, None), 70: ("failed", "broken", 1, 0, None),
}


def sha(text):
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


def plain(log):
    """The rules, event by event."""
    owner, found = {}, {}
    for _, kind, tenant, _, version, content, error in sorted(log, key=lambda e: e[0]):
        reason = error or ("unreadable" if content is None else None if content.strip() else "blank_text")
        state = found.get(version)
        if kind == "upload":
            mark = (tenant, content if content is not None else ("version", version))
            if mark in owner:
                found[version] = ["duplicate", None, 0, 0, None, False]
                continue
            owner[mark] = version
            state = found[version] = [None, None, 0, 0, None, False]
        if state is None or state[0] == "duplicate":
            continue
        if kind == "reference":
            state[5] = True
        elif state[5]:
            state[3] += 1
        else:
            state[:3], state[4] = ["failed" if reason else "processed", reason, state[2] + 1], None if reason else content
    return {v: tuple(s[:5]) for v, s in found.items()}


def folded(spark, log):
    rows = versions.states(spark.createDataFrame(log, versions.EVENT)).collect()
    assert len({r["version_id"] for r in rows}) == len(rows)
    return {r["version_id"]: (r["status"], r["reason"], r["attempts"], r["n_refused"], r["text_sha256"]) for r in rows}


def hashed(states):
    return {v: (*s[:4], sha(s[4])) for v, s in states.items()}


def test_whole_log(spark):
    assert plain(LOG) == WANTED
    assert folded(spark, LOG) == hashed(WANTED)
    assert folded(spark, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    """Few contents, so that most uploads are copies; citations and retries also of versions that do not exist."""
    draw = random.Random(seed)
    uploaded, log = set(), []
    for n in range(300):
        kind = draw.choice(("upload", "retry", "retry", "reference"))
        version = draw.randrange(80) if kind != "upload" or n > 250 else n + 1000
        if kind == "upload" and version in uploaded:
            continue
        if kind != "upload" and uploaded and draw.random() < 0.8:
            version = draw.choice(sorted(uploaded))
        uploaded |= {version} if kind == "upload" else set()
        content, error = draw.choice(((f"text {draw.randrange(20)}", None), (f"text {draw.randrange(200)}", None), (" ", None), (None, None), (None, "broken")))
        log.append((n, kind, draw.choice("ab") if kind == "upload" else "a", version, version, content, error))
    assert folded(spark, log) == hashed(plain(log))


def test_stream_and_its_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    found = {}
    for part in (LOG[:5], LOG[5:9], LOG[9:]):  # the query ends and starts again between the parts
        spark.createDataFrame(part, versions.EVENT).coalesce(1).write.mode("append").parquet(source)
        versions.process(spark.readStream.schema(versions.EVENT).parquet(source), out, checkpoint).awaitTermination()
        found = {r["version_id"]: (r["status"], r["reason"], r["attempts"], r["n_refused"], r["text"]) for r in versions.current(spark, out).collect()}
        assert found == plain([e for e in LOG if e[0] <= part[-1][0]])
    assert found == WANTED
    assert spark.read.parquet(f"{out}/verdicts").count() == len(LOG)
