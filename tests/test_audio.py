"""Audio operators on synthetic frame tables (silence, tone, chirp)."""

import math

from pyspark.sql import functions as F

from mnemo.operators import audio as AU


def frames(spark, clip, f0s, rms, voiced):
    rows = [(clip, i, float(r), float(f), bool(v)) for i, (f, r, v) in enumerate(zip(f0s, rms, voiced))]
    return spark.createDataFrame(rows, "clip_id long, frame int, rms double, f0 double, voiced boolean")


def test_silence_segments_all_zero(spark):
    n = 94  # 3 s at hop 512
    f = frames(spark, 1, [0.0] * n, [0.0] * n, [False] * n)
    rows = AU.audio_segment_features(f).collect()
    assert len(rows) == 3
    for r in rows:
        assert all(r[c] == 0 for c in AU.SEGMENT_COLS)


def test_tone_and_chirp(spark):
    n = 94
    tone = frames(spark, 1, [220.0] * n, [0.35] * n, [True] * n)
    chirp = frames(spark, 2, [200 + 200 * i / (n - 1) for i in range(n)], [0.35] * n, [True] * n)
    r = {(x["clip_id"], x["seg"]): x for x in AU.audio_segment_features(tone.unionByName(chirp)).collect()}
    for s in range(3):
        assert abs(r[(1, s)]["pitch_mean"] - 220) < 5 and r[(1, s)]["pitch_var"] < 50
        assert r[(1, s)]["energy_mean"] > 0
        assert r[(2, s)]["pitch_var"] > 0 and r[(2, s)]["pitch_vel_mean"] > 0


def test_global_features(spark):
    n = 94
    sil = frames(spark, 1, [0.0] * n, [0.0] * n, [False] * n)
    tone = frames(spark, 2, [220.0] * n, [0.3 + 0.01 * (i % 7) for i in range(n)], [True] * n)
    turns = spark.createDataFrame([(2, 0, "user", "hello world")], "clip_id long, turn long, role string, text string")
    r = {x["clip_id"]: x for x in AU.audio_global_features(sil.unionByName(tone), turns).collect()}
    assert r[1]["energy_mean"] < 1e-6 and r[1]["pitch_mean_hz"] == 0
    assert math.isnan(r[1]["syllable_count"]) and math.isnan(r[1]["speaking_rate"])   # no transcript
    assert abs(r[2]["pitch_mean_hz"] - 220) < 5 and r[2]["energy_mean"] > 0 and math.isfinite(r[2]["snr_db"])
    assert r[2]["syllable_count"] == 3 and r[2]["speaking_rate"] > 0


def test_half_shift_one_voiced_frame_is_nan(spark):
    f = frames(spark, 1, [100.0, 0.0, 0.0], [0.1, 0.1, 0.1], [True, False, False])
    r = AU.half_shift(f, ["clip_id"]).first()
    assert math.isnan(r["pitch_variation"])


def test_snr_without_noise_power(spark):
    # threshold = 35th percentile; inactive frames have rms 0 -> noise power 0
    f = frames(spark, 1, [0.0] * 4, [0.0, 0.0, 0.5, 0.6], [False] * 4)
    r = AU.speech_activity(f, ["clip_id"]).first()
    assert r["snr_db"] == 60.0


def test_segments_long_and_short(spark):
    hop_s = 512 / 16000
    n = int(10 / hop_s)   # 10 s clip, max_seconds 2 -> start / centre / end windows
    f = frames(spark, 1, [100.0] * n, [0.2] * n, [True] * n)
    seg = AU.three_segments(f, max_seconds=2.0)
    got = {r["seg"]: (r["lo"], r["hi"]) for r in seg.groupBy("seg").agg(
        F.min("frame").alias("lo"), F.max("frame").alias("hi")).collect()}
    assert got[0][0] == 0 and got[0][1] * hop_s < 2.0
    mid = n * hop_s / 2
    assert abs(got[1][0] * hop_s - (mid - 1.0)) < hop_s
    assert got[2][1] == n - 1
    short = AU.three_segments(f, max_seconds=60.0)
    sizes = sorted(r["count"] for r in short.groupBy("seg").count().collect())
    assert sum(sizes) == n and sizes[-1] - sizes[0] <= 1


def test_frame_rms_centered(spark):
    rows = [(1, p, 1.0) for p in range(8)]
    s = spark.createDataFrame(rows, "clip_id long, pos long, amp double")
    r = {x["frame"]: x["rms"] for x in AU.frame_rms(s, hop=4, frame_length=8).collect()}
    # frame 0 covers [-4, 4): 4 ones of 8 -> sqrt(0.5); frame 1 [0, 8): all ones
    assert abs(r[0] - math.sqrt(0.5)) < 1e-12 and abs(r[1] - 1.0) < 1e-12 and len(r) == 3


def _hot_frames(spark):
    """One clip with a third of all frames, holes between frames, a silent clip, a clip of one frame and one of two."""
    import random
    rng = random.Random(11)
    sizes = {1: 300, 2: 150, 3: 150, 4: 150, 5: 148, 6: 1, 7: 2}
    rows = []
    for clip, n in sizes.items():
        frame = 0
        for _ in range(n):
            frame += rng.choice([1, 1, 1, 1, 2, 9])
            rows.append((clip, frame - 1, 0.0 if clip == 5 else rng.choice([0.001, 0.5, 1.0]), 80.0 + rng.random(), rng.random() < 0.3))
    return rows, spark.createDataFrame(rows, "clip_id long, frame int, rms double, f0 double, voiced boolean").repartition(4)


def test_blocks_of_a_clip_join_up(spark):
    rows, df = _hot_frames(spark)
    by_clip = {c: sorted(r for r in rows if r[0] == c) for c in {r[0] for r in rows}}
    islands, gap_rows, speeds = [], [], {}
    for c, part in by_clip.items():
        top = max(r[2] for r in part)
        runs = []
        for r in part:
            if top <= 0 or r[2] > top * 10 ** (-1.5):
                if runs and runs[-1][1] == r[1] - 1:
                    runs[-1][1] = r[1]
                else:
                    runs.append([r[1], r[1]])
        islands += [(c, a, b) for a, b in runs]
        gap_rows += [(c, a[0], round((b[0] - a[1] - 1) * 512 / 16000, 9)) for a, b in zip(runs, runs[1:])]
        v = [r for r in part if r[4]]
        d = [(b[3] - a[3]) / ((b[1] - a[1]) * 512 / 16000) for a, b in zip(v, v[1:])]
        speeds[c] = sum(map(abs, d)) / len(d) if d else 0.0
    for block in (1, 2, 7, 64, 1 << 15):
        found = AU.active_islands(df, ["clip_id"], block=block)
        assert sorted((r["clip_id"], r["start"], r["end"]) for r in found.collect()) == sorted(islands)
        g = AU.gaps(found, ["clip_id"], block=block).collect()
        assert sorted((r["clip_id"], r["start"], round(r["gap"], 9)) for r in g) == sorted(gap_rows)
        vel = {r["clip_id"]: r["pitch_vel_mean"] for r in AU.velocity(df, ["clip_id"], block=block).collect()}
        assert vel.keys() == speeds.keys() and all(abs(vel[c] - speeds[c]) < 1e-9 for c in speeds)


def test_windows_over_frames_hold_one_block(spark):
    """Only windows over border states have a whole clip."""
    _, df = _hot_frames(spark)
    for plan in (AU.velocity(df, ["clip_id"]), AU.gaps(AU.active_islands(df, ["clip_id"]), ["clip_id"])):
        for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines():
            if "Window [" in line:
                assert "_blk" in line.split("windowspecdefinition(")[1] or "_new" in line or "_edge" in line or "lag(end" in line, line


def test_every_clip_has_three_segments(spark):
    rows, df = _hot_frames(spark)
    out = AU.audio_segment_features(df).collect()
    assert sorted((r["clip_id"], r["seg"]) for r in out) == [(c, s) for c in range(1, 8) for s in range(3)]
    empty = [r for r in out if r["clip_id"] == 6 and r["seg"] > 0]
    assert empty and all(r["vector"] == [0.0] * 9 for r in empty)


def test_frame_rms_of_uneven_hops(spark):
    import random
    rng = random.Random(4)
    rows = [(c, p, rng.uniform(-1, 1)) for c in (1, 2) for p in range(rng.randrange(50, 90))]
    df = spark.createDataFrame(rows, "clip_id long, pos long, amp double")
    for hop, length in ((4, 16), (3, 16), (5, 8), (8, 8), (12, 8)):
        want = {}
        for c in (1, 2):
            x = {p: a for k, p, a in rows if k == c}
            for f in range((max(x) + 1) // hop + 1):
                at = range(f * hop - length // 2, f * hop + length // 2)
                if any(p in x for p in at):
                    want[c, f] = (sum(x.get(p, 0.0) ** 2 for p in at) / length) ** 0.5
        got = {(r["clip_id"], r["frame"]): r["rms"] for r in AU.frame_rms(df, hop, length).collect()}
        assert got.keys() == want.keys(), (hop, length)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
