"""A generated capture, from file to report."""

import random
import struct

import pytest

from tidemark.config import Settings, SettingsError
from tidemark.dimensions import VELOCITY_FEATURES
from tidemark.errors import CaptureError, DetectionError, InvalidCapturePath
from tidemark.operators import windows
from tidemark.plans import workflows
from tidemark.sources import pcap


def ip(number, body):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, number, 0, b"\x0a\0\0\1", b"\x0a\0\0\2") + body


def tcp(src, dst, flags, payload=b""):
    return ip(6, struct.pack(">HHIIBBHHH", src, dst, 0, 0, 0x50, flags, 0, 0, 0) + payload)


def udp(src, dst, payload):
    return ip(17, struct.pack(">HHHH", src, dst, 8 + len(payload), 0) + payload)


def ethernet(packet, kind=0x0800):
    return b"\0" * 12 + struct.pack(">H", kind) + packet


def capture(frames, link=1):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for t, f in frames:
        out += struct.pack("<IIII", int(t), int(round(t % 1 * 1e6)), len(f), len(f)) + f
    return out


def next_generation(frames):
    out = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28) + struct.pack("<IIHHII", 1, 20, 1, 0, 0, 20)
    for t, f in frames:
        us, pad = int(t * 1e6), -len(f) % 4
        size = 32 + len(f) + pad
        out += struct.pack("<IIIIIII", 6, size, 0, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * pad + struct.pack("<I", size)
    return out


FRAMES = [
    (1000.25, ethernet(tcp(40000, 443, 2, b"hello"))), (1000.5, ethernet(tcp(443, 40000, 18, b"a" * 40))), (1001.0, ethernet(udp(5000, 53, b"q" * 20))), (1001.5, ethernet(ip(1, b"\x08\0" + b"\0" * 30))),
    (1002.0, ethernet(b"\x60" + b"\0" * 60, 0x86DD)), (1002.5, ethernet(udp(1, 2, b"x"))), (1003.0, b"\1\2\3"),
]


@pytest.mark.parametrize("make", [capture, next_generation])
def test_formats_and_filters(make):
    rows = [r for r in (pcap.parse(*f) for f in pcap.frames(make(FRAMES))) if r]
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in rows] == [(6, 40000, 443, 2, 5), (6, 443, 40000, 18, 40), (17, 5000, 53, 0, 20), (1, -1, -1, 0, 32)]
    assert abs(rows[0][0] - 1000.25) < 1e-6 and rows[1][7] == 0.0


def test_other_links():
    assert pcap.ip_packet(101, tcp(1, 2, 0)) == tcp(1, 2, 0)
    assert pcap.ip_packet(113, b"\0" * 14 + b"\x08\0" + tcp(1, 2, 0)) == tcp(1, 2, 0)
    with pytest.raises(CaptureError):
        list(pcap.frames(b"nonsense"))


def test_source_and_reader_agree(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(FRAMES))
    spark.dataSource.register(pcap.CaptureSource)
    one = pcap.as_packets(spark.read.format("capture").load(str(tmp_path / "a.pcap")))
    two = pcap.read_captures(spark, str(tmp_path / "a.pcap"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    got = {(r.protocol, r.direction, r.server_port, r.tcp_flags_syn, r.req_payload, r.res_payload, r.bucket) for r in two.collect()}
    assert ("TCP", "outbound", 443, 1, 5, 0, 1000) in got and ("TCP", "inbound", 443, 1, 0, 40, 1000) in got and ("ICMP", "unknown", -1, 0, 0, 0, 1001) in got
    with pytest.raises(InvalidCapturePath):
        pcap.check_path(str(tmp_path / "none.pcap"))
    with pytest.raises(InvalidCapturePath):
        pcap.check_path(str(tmp_path))


@pytest.mark.parametrize("split", [1000, 70_000, 1 << 20])
def test_ranges_of_a_file_are_read_apart(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(pcap, "MOST_RECORD", 3000)
    rng, frames = random.Random(9), []
    inner = capture([(1_600_000_000 + i, ethernet(udp(7, 8, b"z" * 20))) for i in range(10)])  # a capture sent in a packet
    for i in range(900):
        body = inner if i % 50 == 7 else rng.randbytes(rng.randint(0, 1200))
        frames.append((1_700_000_000 + i / 8, ethernet(udp(5000, 53, body))))
    data = capture(frames)
    (tmp_path / "a.pcap").write_bytes(data)
    whole = list(pcap.frames(data))
    reader = pcap._Reader({"path": str(tmp_path / "a.pcap"), "splitBytes": str(split)})
    parts = reader.partitions()
    assert len(parts) == (1 if len(data) <= split else -(-len(data) // split))
    got = []
    for p in parts:
        with open(p.path, "rb") as f:
            got += list(pcap.frames(f, p.start, p.end))
    assert got == whole and len(whole) == 900


def test_left_out_frames_are_counted(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(FRAMES))
    r = pcap.skipped(spark, str(tmp_path / "a.pcap")).first()
    assert (r.capture_id, r.frames, r.rows) == ("a.pcap", 7, 4) and r.left_out + r.malformed == 3


def traffic(seconds, flood=()):
    rng, out = random.Random(5), []
    for s in range(seconds):
        n = 400 if s in flood else rng.randint(3, 9)
        for i in range(n):
            t = 1_700_000_000 + s + (i + 0.5) / (n + 1)
            pick = rng.random()
            if s in flood or pick < 0.2:
                out.append((t, ethernet(tcp(40000 + i, 80, 2, b""))))
            elif pick < 0.7:
                out.append((t, ethernet(tcp(40000, 443, 24, bytes(rng.randrange(256) for _ in range(rng.randint(20, 200)))))))
            else:
                out.append((t, ethernet(udp(5000, 53, bytes(rng.randrange(256) for _ in range(rng.randint(20, 60)))))))
    return out


def test_train_detect_report(spark, tmp_path):
    settings = Settings.of({"mixture": {"adaptive": False, "components": 2, "max_iter": 5}, "forest": {"trees": 20}})
    (tmp_path / "calm.pcap").write_bytes(capture(traffic(150)))
    (tmp_path / "attack.pcap").write_bytes(capture(traffic(150, range(100, 112))))
    trained = workflows.train(pcap.read_captures(spark, str(tmp_path / "calm.pcap")), settings, audit=str(tmp_path / "audit"))
    assert spark.read.option("header", True).csv(str(tmp_path / "audit")).count() == 150
    trained.save(spark, str(tmp_path / "bundle"))
    bundle = workflows.Bundle.load(spark, str(tmp_path / "bundle"))
    assert bundle.document() == trained.document()
    summary = workflows.run(spark, pcap.read_captures(spark, str(tmp_path / "attack.pcap")), bundle, str(tmp_path / "out"), settings)
    rows = spark.read.parquet(str(tmp_path / "out/results.parquet")).orderBy("bucket").collect()
    assert summary["windows"] == len(rows) == 150
    flagged = {r.bucket - 1_700_000_000 for r in rows if r.is_anomaly}
    assert len(flagged & set(range(100, 112))) >= 10
    assert all(r.is_anomaly for r in rows if r.vel_bypass) and all(r.severity == 0 for r in rows if not r.is_anomaly)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out/report")).collect())
    assert all(f"## {x}" in text for x in ("Parameters", "Summary", "Families", "Incidents", "Data drops"))
    found = workflows.report(spark.read.parquet(str(tmp_path / "out/results.parquet")), settings)
    shown = found["reportable"].orderBy("start_time").collect()
    assert shown and all(f"incident {r.incident_id + 1}" in text and f"{r.start_time:%Y-%m-%d %H:%M:%S}" in text for r in shown)
    assert "| 0 | volume |" in text and found["radar"].count() == 6
    assert workflows.load_scaler(spark, str(tmp_path / "bundle/scaler")) == bundle.scaler
    assert workflows.pdf(found, str(tmp_path / "r.pdf")) is False and not (tmp_path / "r.pdf").exists()
    matrix = windows.window_features(pcap.read_captures(spark, str(tmp_path / "attack.pcap")), bundle.protocols)
    with pytest.raises(DetectionError, match="bytes_velocity"):
        workflows.detect_matrix(matrix.drop("bytes_velocity"), bundle, settings)
    assert workflows.detect_matrix(matrix.drop(*VELOCITY_FEATURES), bundle, settings).filter("vel_bypass").count() == 0


def test_settings_report_all_violations(tmp_path):
    with pytest.raises(SettingsError) as e:
        Settings.of({"forest": {"contamination": 0.9}, "neighbours": {"k": 0}})
    assert len(e.value.args[0]) == 2
    (tmp_path / "s.yaml").write_text("velocity: {bypass_threshold: 7}\n")
    assert Settings.load(str(tmp_path / "s.yaml")).velocity.bypass_threshold == 7
    with pytest.raises(SettingsError):
        Settings.of({"nothing": {}})
