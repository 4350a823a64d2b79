import struct

import pytest

from netloom.operators import flows as P
from netloom.operators import normalize as N
from netloom.sources import flow_files, pcap, sinks


def ipv4(src, dst, proto, payload, fragment=0):
    head = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 0, fragment, 64, proto, 0, bytes(src), bytes(dst))
    return head + payload


def tcp(sport, dport, flags):
    return struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0)


def ethernet(packet, kind=0x0800, vlan=0):
    return b"\0" * 12 + b"\x81\x00\x00\x01" * vlan + struct.pack("!H", kind) + packet


def capture(frames, magic=b"\xd4\xc3\xb2\xa1", order="<"):
    out = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1)
    for seconds, fraction, frame in frames:
        out += struct.pack(order + "IIII", seconds, fraction, len(frame), len(frame)) + frame
    return out


A, B = (10, 0, 0, 1), (10, 0, 0, 2)


def test_pcap(spark, tmp_path):
    frames = [
        (1, 0, ethernet(ipv4(A, B, 6, tcp(1000, 80, 2)))),
        (1, 5, ethernet(ipv4(B, A, 6, tcp(80, 1000, 18)), vlan=2)),
        (1, 9, ethernet(ipv4(A, B, 6, tcp(1000, 80, 16)))),
        (2, 0, ethernet(ipv4(A, B, 17, b"\0" * 8, fragment=1))),
        (2, 0, ethernet(b"\0" * 30, kind=0x0806)),
        (3, 0, ethernet(ipv4(A, B, 6, b"short"))),
        (3, 0, ethernet(ipv4(A, B, 6, tcp(1, 2, 0)), vlan=3)),
    ]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    (tmp_path / "b.pcap").write_bytes(capture(frames[:1], b"\xa1\xb2\x3c\x4d", ">"))
    packets = pcap.read_packets(spark, str(tmp_path)).orderBy("path", "capture_index").collect()
    assert [p.timestamp_ns for p in packets] == [10**9, 10**9 + 5000, 10**9 + 9000, 10**9]
    assert [p.tcp_flags for p in packets] == [2, 18, 16, 2]
    audit = {(r.path[-6:], r.reason): r.n for r in pcap.read_audit(spark, str(tmp_path)).collect()}
    assert audit["a.pcap", "ipv4_fragment"] == audit["a.pcap", "non_ip"] == audit["a.pcap", "malformed"] == audit["a.pcap", "unsupported_encapsulation"] == 1
    flow = P.transport(P.sessions(pcap.read_packets(spark, str(tmp_path / "a.pcap")))).collect()
    assert [f.portable_connection_state for f in flow] == ["TCP_ESTABLISHED"]
    with pytest.raises(pcap.CaptureError):
        pcap.parse(b"\x0a\x0d\x0d\x0a" + b"\0" * 30)
    with pytest.raises(pcap.CaptureError):
        pcap.parse(capture(frames), strict=True)


def test_idle_gap_is_strict(spark):
    second = 10**9
    rows = [(i, t, "a", "b", 17, 1, 2, 100, None) for i, t in enumerate((0, 60 * second, 120 * second + 1))]
    df = spark.createDataFrame(rows, "capture_index long, timestamp_ns long, src_address string, dst_address string, ip_protocol int, src_port int, dst_port int, ip_total_length int, tcp_flags int")
    flows = P.flow_features(P.sessions(df)).orderBy("start_ns").collect()
    assert [f.total_packet_count for f in flows] == [2, 1]
    assert flows[1].packets_per_second is None and flows[1].backward_mean_packet_size_bytes is None
    assert P.invalid(df).count() == 0


def test_interval_join_ways_agree(spark):
    rows = [(i, i * 10**12, "a", "b", 6, 1, 2, 100, 16) for i in range(20)]
    packets = spark.createDataFrame(rows, "capture_index long, timestamp_ns long, src_address string, dst_address string, ip_protocol int, src_port int, dst_port int, ip_total_length int, tcp_flags int")
    rules = spark.createDataFrame(
        [("r1", 0, 5 * 10**12, "x", "ATTACK", None, "a", None, None, None), ("r2", 5 * 10**12, 9 * 10**12, "y", "NORMAL", 6, None, None, None, None)],
        "rule_id string, start_ns long, end_ns long, source_label string, portable_label string, ip_protocol int, source_address string, destination_address string, source_port int, destination_port int",
    )
    flows = P.flow_features(P.sessions(packets, 10**9))
    few = sorted(map(str, P.join_rules(flows, rules, "first_index").collect()))
    many = sorted(map(str, P.join_rules(flows, rules, "first_index", max_broadcast=0).collect()))
    assert few == many and sum("AMBIGUOUS" in r for r in few) == 1 and sum("UNMATCHED" in r for r in few) == 10


def test_csv_roles_and_normalisation(spark, tmp_path):
    named, plain = tmp_path / "named.csv", tmp_path / "plain.csv"
    named.write_text("Src IP,Dst-IP,Protocol,Duration,Sent_Bytes,label\n1.1.1.1,2.2.2.2,tcp,0.5,100,0\n")
    plain.write_text(",".join(["x"] * 49) + "\n")
    df = flow_files.read_roles(spark, {"train": [str(named)], "test": [str(plain)]})
    assert df.count() == 2 and {"src_ip", "srcip", "__source_role", "__source_file"} <= set(df.columns)
    with pytest.raises(ValueError):
        flow_files.read_roles(spark, {"train": [str(named)], "test": [str(named)]})
    raw = flow_files.read_upload(spark, str(named))
    out, report = N.normalize(raw)
    assert report["schema"] == "firewall_or_flow_csv" and out.first().sload == 1600.0
    assert N.check_upload(raw, 100) == ([], [])
    errors, _ = N.check_upload(raw.toDF("a", "a", "c", "d", "e", ""), 1 << 30)
    assert len(errors) == 3


def test_latin1_upload(spark, tmp_path):
    f = tmp_path / "l.csv"
    f.write_bytes("name,n\ncafé,1\n".encode("latin-1"))
    assert flow_files.read_upload(spark, str(f)).first().name == "café"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, -0.0, "b"), (2, 1.5, None)], "a long, x double, s string")
    out = f"file://{tmp_path}/once"
    assert sinks.write_once(df, out) and not sinks.write_once(df.orderBy("a", ascending=False), out)
    with pytest.raises(ValueError):
        sinks.write_once(df.limit(1), out)
    assert sinks.content_hash(df) == sinks.content_hash(df.repartition(3))
    assert sinks.canonical_json(df).orderBy("line").first().line == '{"a":1,"s":"b","x":0.0}'
    sinks.write_csv(df, f"{tmp_path}/csv", "a")
    before = flow_files.file_manifest(spark, f"{tmp_path}/once")
    assert flow_files.manifest_changes(before, before.limit(0)).where("change = 'removed'").count() == before.count()
