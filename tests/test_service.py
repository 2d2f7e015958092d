"""Settings, audio, snapshots, the session and its socket service."""

import io
import socket
import struct
import threading
import wave
from dataclasses import dataclass

import numpy as np
import pytest

from segspark.service import COMMANDS, FAILED, OK, Mixture, Recogniser, Server
from segspark.sources import audio, config, formats


@dataclass(frozen=True)
class Wanted:
    name: str
    count: int = 3
    fast: bool = False
    rate: float = 0.5


def test_settings():
    found = config.parse(["name test ignored words", "", "# no 1", "count 7"])
    assert config.settings(Wanted, config.overlay(found, ["--fast", "--rate", "2"])) == Wanted("test", 7, True, 2.0)
    with pytest.raises(ValueError, match="missing: name"):
        config.settings(Wanted, {})
    with pytest.raises(ValueError, match="count"):
        config.settings(Wanted, {"name": "x", "count": "many"})
    with pytest.raises(ValueError):
        config.overlay({}, ["name"])


def tone(hz, seconds=0.5, rate=8000):
    return (8000 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype("<i2")


def waved(x, rate=8000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    return out.getvalue()


def test_cepstra_have_a_frame_each_shift():
    a = audio.Analysis(energy=True, delta=True)
    x = tone(440).astype(float)
    assert audio.cepstra(x, a).shape == ((4000 - 160) // 80 + 1, 26)
    assert audio.cepstra(x[:100], audio.Analysis()).shape == (0, 12)
    assert np.allclose(audio.cepstra(x, audio.Analysis(centre=True)).mean(0), 0)
    assert np.isfinite(audio.cepstra(np.zeros(1000), audio.Analysis())).all()


def test_cepstra_are_the_cosine_transform_of_log_filters():
    a, x = audio.Analysis(mel=True), tone(700, 0.02).astype(float)
    bright = np.array([x[0]] + [x[i] - 0.95 * x[i - 1] for i in range(1, len(x))]) * np.hamming(160)
    logs = np.log(audio.filter_bank(a, 8000) @ np.abs(np.fft.rfft(bright, 512)))
    want = [np.sqrt(2 / 24) * sum(logs[j] * np.cos(np.pi * k * (j + 0.5) / 24) for j in range(24)) for k in range(1, 13)]
    assert np.allclose(audio.cepstra(x, a)[0], want)


def test_files_to_frames(spark, tmp_path):
    x = tone(300)
    (tmp_path / "a.wav").write_bytes(waved(np.stack([x, tone(900)], 1), channels=2))
    (tmp_path / "b.raw").write_bytes(x.tobytes())
    got = audio.read_cepstra(spark, str(tmp_path)).collect()
    by = {s: [r["v"] for r in sorted(got, key=lambda r: r["frame_idx"]) if r["source"] == s] for s in "ab"}
    assert len(by["a"]) == 49 and np.allclose(by["a"], by["b"])


def test_snapshot_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "key long, n array<double>")
    assert formats.snapshot(rows, str(tmp_path / "s")).collect() == rows.collect() == formats.restored(spark, str(tmp_path / "s")).collect()


def world():
    return Mixture(np.array([0.5, 0.5]), np.array([[0.0, 0.0], [4.0, 4.0]]), np.ones((2, 2)))


def test_running_score_is_the_mean_over_frames(tmp_path):
    s = Recogniser(tmp_path, {"vectSize": "2"})
    s.world = world()
    rng = np.random.default_rng(0)
    s.features = [rng.normal(size=(30, 2)) + 1]
    s.enrol("a")
    whole = []
    for n in (10, 5, 25):
        s.features = [rng.normal(size=(n, 2))]
        score = s.score("a")
        whole += [score] * n
        assert np.isclose(s.score("a", accumulate=True), np.mean(whole))
    with pytest.raises(ValueError):
        s.path("../x")


def test_service(tmp_path):
    (tmp_path / "world.json").write_text(world().saved())
    server = Server(Recogniser(tmp_path))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rng = np.random.default_rng(1)
    frames = {k: (rng.normal(size=(50, 2)) * 0.3 + m).astype("<f4") for k, m in (("a", 1.0), ("b", 3.0))}
    with socket.create_connection(server.server_address, timeout=20) as c:

        def ask(name, data=b"", size=1):
            c.sendall(struct.pack("!BI", COMMANDS[name], len(data)) + data)
            out = b""
            while len(out) < size:
                out += c.recv(size - len(out))
            return out

        assert ask("M_WLOAD", b"world.json\0") == bytes([OK])
        for k, x in frames.items():
            assert ask("F_RESET") == bytes([OK])
            assert ask("F_SEND", x.tobytes()) == bytes([OK]) and ask("F_SEND") == bytes([OK])
            assert ask("M_TRAIN", k.encode() + b"\0") == bytes([OK])
        status = ask("G_STATUS", size=1 + 8 + 4 + 1)
        assert struct.unpack("!BII", status[:9]) == (OK, 50, 2) and status[9:] == b"a\0b\0\1"
        state, score, yes = struct.unpack("<Bf?", (found := ask("I_ID", size=8))[:6])
        assert state == OK and yes and score > 0 and found[6:] == b"b\0"
        first = struct.unpack("<Bf?", ask("I_DETCUM", b"a\0", 6))
        assert first[0] == OK and first[1] < score and ask("I_DETCUMR", b"a\0") == bytes([OK])
        assert ask("M_SAVE", b"b\0b.json\0") == ask("M_DEL", b"b\0") == ask("M_LOAD", b"c\0b.json\0") == bytes([OK])
        assert ask("M_ADAPT", b"c\0") == ask("G_SENDOPT", b"decisionThreshold\09\0") == bytes([OK])
        assert not struct.unpack("<Bf?", ask("I_DET", b"c\0", 6))[2]
        assert ask("I_DET", b"nobody\0") == ask("F_LOAD", b"../secret\0") == bytes([FAILED])
        assert ask("A_SEND", tone(500).tobytes()) == bytes([OK]) and ask("A_SEND") == bytes([OK])
    server.shutdown()
    server.server_close()
