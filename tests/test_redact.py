"""Every redaction form against a direct left-to-right, longest-first scan."""

import os
import random
import time

import pytest

from fleetloom.operators import redact as ops
from fleetloom.streaming.redaction import Masker, live_parts, live_secrets, redact_live, redact_stream
from fleetloom.streaming.replay import replay

M = ops.MARKER

# (secrets, chunks, text shown before the stream is closed or None, whole result)
CASES = [
    ([], ["nothing to hide"], None, "nothing to hide"),
    (["qqq"], ["nothing to hide"], None, "nothing to hide"),
    (["hide"], ["nothing to hide"], None, f"nothing to {M}"),
    (["noth"], ["nothing"], None, f"{M}ing"),
    (["to hi"], ["nothing to", " hide"], None, f"nothing {M}de"),
    (["xy"], list("xxyx"), None, f"x{M}x"),
    (["pq", "rs"], ["pq, rs"], None, f"{M}, {M}"),
    (["abab"], ["ababab"], None, f"{M}ab"),
    (["key"], list("key"), None, M),
    (["key"], ["a ke"], "a ", "a ke"),
    (["", "k"], ["k"], None, M),
    (["z", "wxyq"], ["wxyz"], None, f"wxy{M}"),
    (["yz", "wxyq"], ["wx", "yz"], None, f"wx{M}"),
    (["one", "one two"], ["one t", "wo"], None, M),
    (["one", "one two"], ["one t", "en"], None, f"{M} ten"),
    (["k", "key"], ["ak"], "a", f"a{M}"),
    (["b" * 7, "b"], ["b" * 8], M, M + M),
    (["key"], ["ke\n"], "ke\n", "ke\n"),
    (["a.c", "[x]", "$1\\"], ["abc a.c [x] $1\\"], None, f"abc {M} {M} {M}"),
    (["näh", "日本"], ["nähe ", "日", "本語"], None, f"{M}e {M}語"),
]


def scan(text, secrets):
    words, out, pos = [s for s in secrets if s], [], 0
    while pos < len(text):
        best = max((len(w) for w in words if text.startswith(w, pos)), default=0)
        out.append(M if best else text[pos])
        pos += best or 1
    return "".join(out)


def table(spark, values, name="secret"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("secrets, chunks, early, expected", CASES)
def test_scan_and_masker(secrets, chunks, early, expected):
    assert scan("".join(chunks), secrets) == expected
    masker, shown, tail = Masker(secrets), "", ""
    for chunk in chunks:
        part, tail = masker.drain(tail + chunk, flush=False)
        shown += part
    if early is not None:
        assert shown == early
    assert shown + masker.drain(tail, flush=True)[0] == expected


def test_masker_on_random_streams():
    rng = random.Random(3)
    for _ in range(2000):
        secrets = ["".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 4))]
        text = "".join(rng.choices("abc", k=rng.randint(0, 20)))
        masker, shown, tail, pos = Masker(secrets), "", "", 0
        while pos < len(text):
            step = rng.randint(1, 4)
            part, tail = masker.drain(tail + text[pos : pos + step], flush=False)
            shown, pos = shown + part, pos + step
        assert shown + masker.drain(tail, flush=True)[0] == scan(text, secrets), (secrets, text)


@pytest.mark.parametrize("number", range(0, len(CASES), 3))
def test_cases_in_spark(spark, number):
    secrets, chunks, _, expected = CASES[number]
    known = ops.secret_set(table(spark, secrets))
    docs = spark.createDataFrame([(1, "".join(chunks))], "id int, t string")
    assert ops.redact(docs, "t", known).first().t == expected
    assert ops.redact_large(docs, "t", known).first().t == expected


def random_world(seed, texts, length):
    rng = random.Random(seed)
    secrets = {"".join(rng.choices("abc", k=rng.randint(2, 9))) for _ in range(25)}
    return sorted(secrets), ["".join(rng.choices("abcd ", k=rng.randint(0, length))) for _ in range(texts)]


@pytest.mark.parametrize("prefix_chars, max_prefixes", [((1, 2), 1000), ((1, 3, 4), 5), (ops.PREFIX_CHARS, 1000)])
def test_both_forms_equal_the_scan(spark, prefix_chars, max_prefixes):
    secrets, texts = random_world(17, 60, 300)
    texts.append("abc" * 3000)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    known = table(spark, secrets)
    expected = {i: scan(text, secrets) for i, text in enumerate(texts)}
    small = {r.id: r.t for r in ops.redact(docs, "t", known).collect()}
    large = ops.redact_large(docs, "t", known, prefix_chars, max_prefixes)
    assert small == expected
    assert {r.id: r.t for r in large.collect()} == expected


def test_many_secrets_take_the_joined_form(spark, monkeypatch):
    monkeypatch.setattr(ops, "MAX_PATTERN_SECRETS", 3)
    secrets, texts = random_world(29, 10, 80)
    known = table(spark, secrets)
    assert ops.bounded_secrets(known) is None
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.t for r in ops.redact(docs, "t", known).collect()}
    assert got == {i: scan(text, secrets) for i, text in enumerate(texts)}


def test_rows_with_missing_and_repeated_keys(spark):
    texts = [(None, "x SECRETVALUE y"), (None, "aa SECRETVALUE"), (1, "SECRETVALUE"), (1, "a SECRETVALUE b"), (1, None), (2, "")]
    docs = spark.createDataFrame([(k, t, k) for k, t in texts], "_text int, t string, _hits int")
    known = table(spark, ["SECRETVALUE", "L" * 4000])
    expected = sorted(((k, t and t.replace("SECRETVALUE", M)) for k, t in texts), key=repr)
    for done in (ops.redact(docs, "t", known), ops.redact_large(docs, "t", known)):
        assert done.columns == docs.columns
        assert sorted(((r["_text"], r.t) for r in done.collect()), key=repr) == expected


def test_chunks_of_odd_streams(spark):
    far = 10**15
    rows = [(None, 0, "x SECRET"), (None, far, "VALUE y"), ("s", 5, "SECRETV"), ("s", 10**12, "ALUE")]
    log = spark.createDataFrame(rows, "stream_id string, seq long, chunk string")
    done = ops.redact_chunks(log, table(spark, ["SECRETVALUE"]))
    assert sorted(((r.stream_id, r.text) for r in done.collect()), key=repr) == sorted([(None, f"x {M} y"), ("s", M)], key=repr)
    with pytest.raises(ValueError, match="same seq"):
        ops.redact_chunks(log.union(log.limit(1)), table(spark, ["SECRETVALUE"]))


def test_redaction_runs_without_python(spark):
    docs = spark.createDataFrame([(1, "a key")], "id int, t string")
    plan = ops.redact(docs, "t", table(spark, ["key"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def joined(df, order):
    texts = {}
    for row in sorted(df.collect(), key=lambda r: (r.stream_id or "", r[order])):
        texts[row.stream_id] = texts.get(row.stream_id, "") + row.text
    return texts


def cut(rng, text, most):
    pieces, pos = [], 0
    while pos < len(text):
        step = rng.randint(1, most)
        pieces.append(text[pos : pos + step])
        pos += step
    return pieces


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(41)
    secrets, texts = random_world(41, 12, 120)
    texts += ["ab" * 200, "aba" * 70, "a" * 333]
    secrets = sorted({*secrets, "aa", "abab", "ba"})
    chunks = {f"s{i}": cut(rng, text, 9) for i, text in enumerate(texts)}
    expected = {name: scan("".join(parts), secrets) for name, parts in chunks.items()}
    return secrets, chunks, {name: text for name, text in expected.items() if text}


@pytest.mark.parametrize("block, prefix", [(10, (1, 2)), (64, ops.PREFIX_CHARS)])
def test_chunked_streams_equal_the_scan(spark, streams, block, prefix):
    secrets, chunks, expected = streams
    rows = [(name, seq, chunk) for name, parts in chunks.items() for seq, chunk in enumerate(parts)]
    log = spark.createDataFrame(rows, "stream_id string, seq long, chunk string").repartition(5)
    done = ops.redact_chunks(log, table(spark, secrets), block, 50, prefix)
    assert joined(done, "page") == expected
    assert max(len(r.text) for r in done.collect()) == 50


@pytest.mark.parametrize("seed", [1, 2])
def test_live_stream_equals_the_scan(spark, streams, seed):
    secrets, chunks, expected = streams
    rng = random.Random(seed)
    rows = [
        (name, seq, chunk, seq == len(parts) - 1)
        for name, parts in chunks.items()
        for seq, chunk in enumerate(parts)
    ]
    rng.shuffle(rows)
    schema = "stream_id string, seq long, chunk string, last boolean"
    third = len(rows) // 3
    slices = [spark.createDataFrame(part, schema) for part in (rows[:third], rows[third : 2 * third], rows[2 * third :])]
    parts = replay(slices, lambda stream: redact_stream(stream, secrets), "test-redaction")
    assert joined(parts, "part") == expected


def test_more_secrets_than_a_pattern_holds():
    rng = random.Random(8)
    for _ in range(300):
        secrets = ["".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 8))]
        text = "".join(rng.choices("abc", k=rng.randint(0, 30)))
        masker, shown, tail = Masker(secrets, pattern_secrets=0), "", ""
        for piece in cut(rng, text, 4):
            part, tail = masker.drain(tail + piece, flush=False)
            shown += part
        assert shown + masker.drain(tail, flush=True)[0] == scan(text, secrets)


def test_many_live_secrets(spark):
    secrets = [f"secret-{i:05d}" for i in range(2500)]
    rows = [("s", 0, "a secret-0", False), ("s", 1, "0042 and secret-02499", True)]
    log = spark.createDataFrame(rows, "stream_id string, seq long, chunk string, last boolean")
    values = live_secrets(table(spark, secrets))
    parts = replay([log], lambda stream: redact_stream(stream, values), "many-secrets")
    assert joined(parts, "part") == {"s": f"a {M} and {M}"}
    with pytest.raises(ValueError, match="more than a live stream"):
        live_secrets(table(spark, secrets), 100)


def test_idle_streams_close_and_report_late_chunks(spark, tmp_path):
    schema = "stream_id string, seq long, chunk string, last boolean"
    source, sink = str(tmp_path / "source"), str(tmp_path / "sink")
    spark.createDataFrame([("s", 0, "zero ", False), ("s", 2, "two ", False)], schema).write.parquet(source)
    stream = redact_stream(spark.readStream.schema(schema).parquet(source), ["key"], idle_ms=1500)
    writer = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "log"))
    running = writer.start()

    def rows():
        return spark.read.schema(stream.schema).parquet(sink).collect() if os.path.isdir(sink) else []

    try:
        for _ in range(100):
            if "two" in "".join(r.text for r in rows()):
                break
            time.sleep(0.3)
        spark.createDataFrame([("s", 1, "key one ", False)], schema).write.mode("append").parquet(source)
        for _ in range(100):
            if "one" in "".join(r.text for r in rows()):
                break
            time.sleep(0.3)
    finally:
        running.stop()
    assert "".join(r.text for r in sorted(rows(), key=lambda r: r.part) if not r.late).startswith("zero two ")
    assert f"{M} one " in [r.text for r in rows()]


def test_secret_set(spark):
    got = ops.secret_set(table(spark, ["a", "", "b"]), table(spark, ["b", None, "c"], "other"))
    assert sorted(r.secret for r in got.collect()) == ["a", "b", "c"]


def test_rechunk_keeps_the_text(spark):
    rows = [("s", i, "x" * (i % 4) + str(i)) for i in range(40)]
    log = spark.createDataFrame(rows, "stream_id string, seq long, chunk string")
    blocks = ops.rechunk(log, 7, 3).orderBy("block").collect()
    whole = "".join(chunk for _, _, chunk in rows)
    assert [b.text for b in blocks] == [whole[i : i + 10] for i in range(0, len(whole), 7)]
    assert sum(b.body for b in blocks) == len(whole)


def test_pattern_prefers_the_longest():
    import re

    pattern = ops.secret_pattern(["ab", "abc", "abcde", "x"])
    assert re.sub(pattern, "#", "abcd abcde ab x") == "#d # # #"
    assert ops.secret_pattern([""]) == ""


CHUNKS = "stream_id string, seq long, chunk string, last boolean"


def run_live(spark, folder, slices, vault=None, before=()):
    """Feed the slices one by one; *before* adds secrets ahead of a slice."""
    vault = vault or f"{folder}/vault"
    for number, rows in enumerate(slices):
        for value in dict(before).get(number, []):
            table(spark, [value]).write.mode("append").parquet(vault)
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(CHUNKS).parquet(f"{folder}/source")
        writer = redact_live(stream, lambda session: session.read.parquet(vault), f"{folder}/out")
        writer.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return live_parts(spark, f"{folder}/out", stream.schema)


def test_live_table_equals_the_scan(spark, streams, tmp_path):
    secrets, chunks, expected = streams
    rng = random.Random(3)
    rows = [(name, seq, chunk, seq == len(parts) - 1) for name, parts in chunks.items() for seq, chunk in enumerate(parts)]
    rng.shuffle(rows)
    half = len(rows) // 2
    table(spark, secrets).write.parquet(str(tmp_path / "vault"))
    # Some chunks are sent twice, and all of one stream again after its end.
    again = [row for row in rows[:half] if rng.random() < 0.3]
    parts = run_live(spark, str(tmp_path), [rows[:half], rows[half:] + again, rows])
    assert {k: v for k, v in joined(parts, "part").items() if v} == {k: v for k, v in expected.items() if v}


def test_a_secret_added_while_the_stream_runs_is_masked(spark, tmp_path):
    slices = [
        [("s", 0, "one alpha two beta ", False), ("t", 1, "gamma", True)],
        [("s", 1, "three alpha beta", False), ("t", 0, "alpha beta beta", False)],
        [("s", 2, "ta", True)],
    ]
    parts = run_live(spark, str(tmp_path), slices, before=[(0, ["alpha"]), (1, ["beta", "betagamma", "betabeta"])])
    # What was given out before stays: the "b" of the first "beta" was out already.
    assert joined(parts, "part") == {"s": f"one {M} two beta three {M} {M}ta", "t": f"{M} {M} {M}"}
    state = spark.read.parquet(f"{tmp_path}/out/open/slot=2")
    assert state.where("kind <> 'closed'").count() == 0


def test_live_state_is_less_than_a_secret(spark, tmp_path):
    rows = [("s", i, "abcdefghij" * 20, False) for i in range(50)] + [(None, 0, "null secretly", True)]
    parts = run_live(spark, str(tmp_path), [rows[:30] + rows[50:], rows[32:50]], before=[(0, ["secret"])])
    state = spark.read.parquet(f"{tmp_path}/out/open/slot=1").where("stream_id = 's'")
    assert state.where("kind = 'open'").select("seq", "text").first() == (30, "fghij")
    assert state.where("kind = 'chunk'").count() == 18
    assert joined(parts, "part")[None] == f"null {M}ly"


def test_live_without_secrets(spark, tmp_path):
    table(spark, ["x"]).limit(0).write.parquet(str(tmp_path / "vault"))
    parts = run_live(spark, str(tmp_path), [[("s", 0, "plain", False), ("s", 1, None, True)]])
    assert joined(parts, "part") == {"s": "plain"}


@pytest.mark.parametrize("bound", [2_000, 1])
def test_several_columns_at_once(spark, monkeypatch, bound):
    monkeypatch.setattr(ops, "MAX_PATTERN_SECRETS", bound)
    secrets = spark.createDataFrame([("abc",), ("abcd",), ("x",)], "secret string")
    rows = spark.createDataFrame([(1, "an abcd", "x"), (2, None, "abc abc"), (2, "", "plain")], "id int, a string, b string")
    found = ops.redact_columns(rows, ["a", "b"], secrets)
    mark = ops.MARKER
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(1, f"an {mark}", mark), (2, None, f"{mark} {mark}"), (2, "", "plain")], key=repr
    )
