"""Meter lines, timed runs, marker joins and clock maps."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import clocks
from quern.operators.measures import interval_join
from quern.streaming import lines, meter, runs


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(lines.MeterLines)
    return spark


def test_lines_of_parts_of_any_size(source, tmp_path):
    rng = random.Random(1)
    texts = {f"m{i}.log": [("x" * rng.randint(0, 30) + "é") if rng.random() < 0.9 else "" for _ in range(40)] for i in range(3)}
    for name, own in texts.items():
        (tmp_path / name).write_bytes("".join(t + rng.choice(["\n", "\r\n"]) for t in own).encode() + b"partial")
    (tmp_path / ".hidden.log").write_text("no\n")
    (tmp_path / "other.txt").write_text("no\n")
    want = sorted((n, t) for n, own in texts.items() for t in own if t)
    for size in (1, 7, 64, 1 << 20):
        got = source.read.format("meter_lines").option("part_bytes", size).option("suffix", ".log").load(str(tmp_path)).collect()
        assert sorted((r.file, r.line) for r in got) == want and len({(r.file, r.at) for r in got}) == len(want)


def test_a_stream_gives_each_line_once(source, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "work")
    folder.mkdir()
    file = folder / "meter.log"

    def run():
        meter.drain(source.readStream.format("meter_lines").load(str(folder)), out)
        return sorted(r.line for r in source.read.parquet(f"{out}/out").collect())

    file.write_bytes(b'{"seq":1}\n{"type":"sample"')
    assert run() == ['{"seq":1}']
    assert run() == ['{"seq":1}']  # a restart has nothing new, and a partial line waits
    with file.open("ab") as f:
        f.write(b',"seq":2}\n')
    (folder / "second.log").write_bytes(b"\xff\n\n  \nlast")
    assert run() == ['{"seq":1}', '{"type":"sample","seq":2}', "�"]


def test_no_files(source, tmp_path):
    assert source.read.format("meter_lines").load(str(tmp_path)).count() == 0


def commands(seed, devices=4, count=40):
    rng, rows = random.Random(seed), []
    for d in range(devices):
        ms, seq = 1_700_000_000_000, 0
        for _ in range(count):
            ms += rng.choice([500, 1000, 40_000, 90_000])
            seq += 1 if rng.random() < 0.93 else 2
            rows.append((f"d{d}", seq, ms, rng.choice(["ARM", "ARM", "START", "START", "STOP", "STOP", "JUMP"]), rng.choice(["r1", "r1", "r1", "r2"])))
    return rows


def plain_runs(rows, expire_ms, upto):
    out = []
    for device in {r[0] for r in rows}:
        state, run, armed, last, lost = "IDLE", "", 0, None, 0
        for ms, seq, command, asked in [*sorted((r[2], r[1], r[3], r[4]) for r in rows if r[0] == device), (upto, None, None, None)]:
            if state == "ARMED" and ms > armed + expire_ms:
                state, run = "IDLE", ""
                out.append((device, None, armed + expire_ms, "EXPIRED", "IDLE", 0))
            if command is None:
                continue
            lost = lost + max(0, seq - (last if last is not None else seq - 1) - 1) if state == "RUNNING" else 0
            last, was = seq if last is None else max(last, seq), state
            state, run, answer = meter.next_state(state, run, command, asked)
            armed = ms if answer == "ARMED" else armed
            out.append((device, seq, ms, "REJECTED" if answer == "STOPPED" and was == "RUNNING" and lost else answer, state, lost if was == "RUNNING" else 0))
    return sorted(out, key=str)


def test_timed_runs_of_shuffled_and_late_rows(spark, tmp_path):
    rows = commands(3)
    end = max(r[2] for r in rows) + 1_000_000
    shuffled = sorted(rows, key=lambda r: r[2] + random.Random(str(r)).randint(0, 200_000))  # late by up to 200 seconds
    schema = "device string, seq bigint, ms bigint, command string, run_id string"
    parts = [shuffled[i : i + 40] for i in range(0, len(shuffled), 40)] + [[("close", 1, end, "JUMP", "")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:02}"))
    key, store = runs.STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        # one file at a time, in the order of their names
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        stream = read.withColumn("ts", F.timestamp_millis("ms")).select("device", "seq", "ts", "command", "run_id")
        meter.drain(runs.timed_runs(stream, "1000 seconds", 60.0), str(tmp_path / "work"))
    finally:
        spark.conf.set(key, before)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "work/out")).where("device <> 'close'").collect()]
    want = plain_runs(rows, 60_000, end - 1_000_000)
    assert sorted(got, key=str) == want
    assert {"EXPIRED", "REJECTED", "STOPPED", "STARTED", "BUSY"} <= {r[3] for r in want}


def test_marker_sessions_with_and_without_samples(spark, tmp_path):
    rng = random.Random(4)
    sessions = [(f"r{i % 5}", 1000 * i, 1000 * i + rng.choice([0, 5, 300, 900])) for i in range(1, 60)]  # time 0 is no later than any watermark
    samples = [(f"r{rng.randrange(5)}", rng.randint(0, 40_000), float(i)) for i in range(500)]
    far = 10_000_000
    for name, rows, schema in (("m", [*sessions, ("close", far, far)], "run_key string, a long, b long"), ("s", [*samples, ("close", far, 0.0)], "run_key string, t long, power_w double")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    m = spark.readStream.schema("run_key string, a long, b long").parquet(str(tmp_path / "m")).select("run_key", F.timestamp_seconds("a").alias("started"), F.timestamp_seconds("b").alias("ended"))
    s = spark.readStream.schema("run_key string, t long, power_w double").parquet(str(tmp_path / "s")).select("run_key", F.timestamp_seconds("t").alias("ts"), "power_w")
    meter.drain(meter.marker_join(s, m, "0 seconds", 1000), str(tmp_path / "work"))
    got = spark.read.parquet(str(tmp_path / "work/out")).where("run_key <> 'close'").groupBy("run_key", F.unix_seconds("started").alias("a")).agg(F.count("ts").alias("n"), F.sum("power_w").alias("p"))
    found = {(r.run_key, r.a): (r.n, r.p) for r in got.collect()}
    assert set(found) == {(k, a) for k, a, _ in sessions}
    for k, a, b in sessions:
        own = [p for key, t, p in samples if key == k and a <= t <= b]
        assert found[k, a] == (len(own), sum(own) if own else None)
    batch = interval_join(spark.createDataFrame(samples, "run string, t long, p double"), spark.createDataFrame(sessions, "run string, a long, b long"), "run", "t", "a", "b", 100.0)
    assert {(r.run, r.a): r.n for r in batch.groupBy("run", "a").agg(F.count("*").alias("n")).collect()} == {k: v[0] for k, v in found.items() if v[0]}


def planted(device, host):
    """Offset and drift of a device's clock: two parts per hundred thousand, and another from 2000 seconds on."""
    return 5.0 * (device + 1) + host + 2e-5 * host if host < 2000 else 5.0 * (device + 1) + host + 0.04 - 3e-5 * (host - 2000)


def test_planted_drift_is_found_to_a_millisecond(spark):
    rng, rows = random.Random(5), []
    for d in range(3):
        for i in range(1600):
            sent = i * 2.5 + rng.random()
            there, back = 0.0005 + rng.expovariate(200), 0.0005 + rng.expovariate(200)
            rows.append((d, sent, sent + there + back, planted(d, sent + there)))
    rows += [(0, 10.0, 9.0, 99.0), (1, 5.0, 5.01, None)]
    sync = spark.createDataFrame(rows, "d int, sent double, received double, device double")
    best = clocks.best_exchanges(sync, ["d"], F.col("sent"), F.col("received"), F.col("device"), 50.0)
    fits = clocks.clock_map(best, ["d"], 1000.0).cache()
    assert fits.count() == 12 and fits.agg(F.max("worst")).first()[0] < 0.002
    markers = [(d, float(h), h + 7.0) for d in range(3) for h in range(20, 3980, 90)]
    mapped = clocks.on_device(spark.createDataFrame(markers, "d int, a double, b double"), fits, ["d"], ["a", "b"], 1000.0).collect()
    assert len(mapped) == len(markers)
    assert all(abs(r.device_a - planted(r.d, r.a)) < 1e-3 and abs(r.device_b - planted(r.d, r.b)) < 1e-3 for r in mapped)
    samples = spark.createDataFrame([(d, planted(d, h / 2)) for d in range(3) for h in range(0, 8000)], "d int, t double")
    sessions = spark.createDataFrame([(0, 100.25, 200.25), (2, 1500.25, 1501.25)], "d int, a double, b double")
    counts = {r.d: r["count"] for r in clocks.device_samples(samples, sessions, fits, "d", "t", "a", "b", 1000.0, 50.0).groupBy("d").count().collect()}
    assert counts == {0: 200, 2: 2}


def test_pieces_without_a_fit_take_a_neighbours(spark):
    rows = [(1, 10.0, 110.0), (1, 20.0, 120.5), (1, 110.0, 215.0), (1, 410.0, 525.0), (2, 5.0, 6.0)]
    fits = {(r.d, r.piece): r for r in clocks.clock_map(spark.createDataFrame(rows, "d int, host double, device double").withColumn("round_trip", F.lit(0.1)), ["d"], 100.0).collect()}
    assert fits[1, 1].origin == 0 and fits[1, 1].drift == pytest.approx(0.05) and fits[1, 4].exchanges == 1 and fits[2, 0].drift is None
