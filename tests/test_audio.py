"""Sound: WAV files, resampling by pieces, bundles."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelark.sources import audio


def write(path, samples, rate, bits=16, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(bits // 8)
        f.setframerate(rate)
        x = np.round(np.clip(samples, -1, 1 - 2.0 ** (1 - bits)) * 2 ** (bits - 1)).astype("int64")
        x = x + 128 if bits == 8 else x
        f.writeframes(b"".join(int(v).to_bytes(4, "little", signed=True)[: bits // 8] if bits != 8 else bytes([int(v)]) for v in x.ravel()))


def whole(rows):
    return np.concatenate([np.asarray(r.samples, "float32") for r in sorted(rows, key=lambda r: r.piece)])


def test_wav_files_of_every_kind(spark, tmp_path):
    r = np.random.RandomState(1)
    audio.register(spark)
    want = {}
    for bits in (8, 16, 24, 32):
        x = r.rand(2000, 2) * 1.8 - 0.9
        write(tmp_path / f"{bits}.wav", x, 500, bits, 2)
        want[f"{bits}.wav"] = x.mean(axis=1), max(2.0 ** (2 - bits), 2e-7)  # single precision
    x = r.rand(700).astype("<f4")
    body = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", 0xFFFFFFFF) + x.tobytes()
    (tmp_path / "f.WAV").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 500, 2000, 4, 32) + body)
    want["f.WAV"] = x, 1e-7
    (tmp_path / "note.txt").write_text("no sound")
    rows = spark.read.format("wav").option("path", str(tmp_path)).option("width", "0.6").option("partition", "1.2").load()
    assert rows.rdd.getNumPartitions() == 4 * 4 + 2
    found = rows.collect()
    for name, (samples, close) in want.items():
        mine = [r for r in found if r.path.endswith("/" + name)]
        assert [r.piece for r in sorted(mine, key=lambda r: r.piece)] == list(range(len(mine))) and mine[0].rate == 500
        assert np.abs(whole(mine) - samples).max() <= close and len(whole(mine)) == len(samples)
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxJUNK")
    with pytest.raises(Exception, match="no WAV file"):
        spark.read.format("wav").option("path", str(tmp_path / "bad.wav")).load().collect()


@pytest.mark.parametrize(("rate", "to"), [(480, 160), (441, 160), (160, 480), (200, 200)])
def test_pieces_resample_as_the_whole(spark, rate, to):
    """The same numbers whether a recording is one array or many pieces."""
    r, width = np.random.RandomState(2), 5.0
    signals = {"a": r.rand(int(rate * 23.3)).astype("float32"), "b": r.rand(int(rate * 5)).astype("float32"), "c": r.rand(7).astype("float32")}
    size = round(width * rate)
    pieces = [(k, p, x[p * size : (p + 1) * size].tolist()) for k, x in signals.items() for p in range(-(-len(x) // size))]
    got = audio.resampled(spark.createDataFrame(pieces, "clip string, piece long, samples array<float>").repartition(5), ["clip"], rate, to, width).collect()
    g = np.gcd(rate, to)
    up, down = to // g, rate // g
    for k, x in signals.items():
        mine = whole([r for r in got if r.clip == k])
        assert np.array_equal(mine, audio.converted(x, 0, 0, -(-len(x) * up // down), up, down)) and len(mine) == -(-len(x) * to // rate)
    if rate == to:
        assert np.allclose(whole([r for r in got if r.clip == "a"]), signals["a"], atol=1e-6)


def test_a_tone_keeps_its_shape():
    t = np.arange(4800) / 4800
    tone = lambda hz, t: np.sin(2 * np.pi * hz * t).astype("float32")
    out = audio.converted(tone(50, t), 0, 0, 1600, 1, 3)
    inside = slice(100, 1500)
    assert np.abs(out - tone(50, np.arange(1600) / 1600))[inside].max() < 2e-3
    assert np.abs(audio.converted(tone(2000, t), 0, 0, 1600, 1, 3))[inside].max() < 0.02  # what the lower rate can't hold is gone


def test_bundles_have_silence_between(spark):
    rate, width = 10, 2.0
    clips = {"x": np.full(33, 0.5), "y": np.full(20, -2.0), "z": np.full(5, 0.25), "w": np.full(41, 1.0)}
    rows = [(k, p, x[p * 20 : (p + 1) * 20].tolist()) for k, x in clips.items() for p in range(-(-len(x) // 20))]
    pieces = spark.createDataFrame(rows, "clip string, piece long, samples array<float>")
    length = audio.seconds(pieces, ["clip"], rate).withColumn("bundle", F.when(F.col("clip") == "w", "two").otherwise("one"))
    placed = audio.placed_recordings(length, "bundle", ["clip"])
    assert {r.clip: (round(r.start, 6), round(r.end, 6)) for r in placed.collect()} == {"x": (0.0, 3.3), "y": (4.3, 6.3), "z": (7.3, 7.8), "w": (0.0, 4.1)}
    got = audio.bundled(pieces, placed, "clip", "bundle", rate, width).collect()
    one = whole([r for r in got if r.bundle == "one"])
    want = np.concatenate([clips["x"], np.zeros(10), clips["y"], np.zeros(10), clips["z"]]) / 2
    assert np.allclose(one, want) and all(len(r.samples) == 20 for r in got if r.bundle == "one" and r.piece < 3)
    assert np.allclose(whole([r for r in got if r.bundle == "two"]), clips["w"])
