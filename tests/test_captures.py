"""The payload fields, the capture source on cut captures, and the raw candidates of flows."""

import random
import struct

import pytest

from netloom.operators import flows as P
from netloom.operators import payloads as L
from netloom.sources import captures, pcap

from test_sources import A, B, capture, ethernet, ipv4


def tcp(sport, dport, flags, seq=0, window=0, payload=b""):
    return struct.pack("!HHIIBBHHH", sport, dport, seq, 0, 5 << 4, flags, window, 0, 0) + payload


def udp(sport, dport, payload):
    return struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) + payload


def frames():
    http = b"GET / HTTP/1.1\r\n\r\n"
    answer = b"HTTP/1.1 200 OK\r\n\r\nhello"
    out = [
        (1, 0, ethernet(ipv4(A, B, 6, tcp(1000, 4444, 2, 100, 4096)))),
        (1, 200_000, ethernet(ipv4(B, A, 6, tcp(4444, 1000, 18, 900, 2048)))),
        (1, 300_000, ethernet(ipv4(A, B, 6, tcp(1000, 4444, 16, 101, 4000, http)))),
        (1, 400_000, ethernet(ipv4(B, A, 6, tcp(4444, 1000, 16, 901, 2000, answer)))),
        (2, 0, ethernet(ipv4(A, B, 17, udp(53, 80, b"\x01\x02")))),
        (2, 0, ethernet(b"\0" * 30, kind=0x0806)),
        (3, 0, ethernet(ipv4(A, B, 6, tcp(5, 21, 24, 7, 8, b"user x\r\n")))),
        (3, 1, ethernet(ipv4(B, A, 6, tcp(21, 5, 24, 9, 8, b"230-welcome")))),
        (4, 0, ethernet(ipv4(A, A, 6, tcp(9, 9, 4)))),
    ]
    r = random.Random(1)
    for i in range(40):  # payloads that look like records of a capture
        fake = struct.pack("<IIII", 5, 9, 4, 4) + b"\0" * 4
        out.append((5 + i, i, ethernet(ipv4(A, B, 17, udp(1 + i, 2, fake * r.randrange(4) + bytes(r.randrange(256) for _ in range(r.randrange(30))))))))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("captures")
    (path / "a.pcap").write_bytes(capture(frames()))
    (path / "b.pcap").write_bytes(capture(frames()[:3], b"\xa1\xb2\x3c\x4d", ">"))
    return path


def test_payload_fields(folder):
    packets, count = pcap.parse((folder / "a.pcap").read_bytes())
    assert packets[0][9:] == (2, 64, 100, 4096, b"") and packets[2][12:] == (4000, b"GET / HTTP/1.1\r\n\r\n")
    assert packets[4][9:] == (None, 64, None, None, b"\x01\x02") and count["non_ip"] == 1


def test_a_capture_cut_anywhere_is_the_whole_one(folder, monkeypatch):
    path = str(folder / "a.pcap")
    size = (folder / "a.pcap").stat().st_size
    whole = list(captures.CaptureReader({"path": path, "payload": "true"}).read(captures.Range(path, 0, size)))
    assert [w[2:] for w in whole] == [p[1:] for p in pcap.parse((folder / "a.pcap").read_bytes())[0]]
    for before in (1 << 20, 300):  # from the beginning of the file, and by search
        monkeypatch.setattr(captures, "BEFORE", before)
        monkeypatch.setattr(captures.Stretch, "first", _searching if before == 300 else captures.Stretch.first)
        reader = captures.CaptureReader({"path": path, "payload": "true"})
        for cut in range(1, size):
            assert list(reader.read(captures.Range(path, 0, cut))) + list(reader.read(captures.Range(path, cut, size))) == whole, (before, cut)


def _searching(self, to):
    """first() of a file whose packets are far shorter than the stretch before a range."""
    if to - 300 > 24:
        one, other = self.searched(to - 300, to), self.searched(to - 150, to)
        if one is not None and one == other:
            return one
    return self.walked(24, to)


def test_data_source(spark, folder):
    captures.register(spark)
    read = lambda **o: spark.read.format("capture").options(**o).load(str(folder))
    whole, cut = read(payload="true"), read(payload="true", rangeBytes="97")
    assert cut.rdd.getNumPartitions() > whole.rdd.getNumPartitions() == 2
    rows = lambda df: sorted(tuple(r) for r in df.withColumn("payload", df.payload.cast("string")).fillna(-1).collect())
    assert rows(whole) == rows(cut) and len(rows(cut)) == len(frames()) - 1 + 3
    assert read().columns == [c.split()[0] for c in captures.SCHEMA.split(", ")]
    one = pcap.read_packets(spark, str(folder / "a.pcap"), payload=True).orderBy("capture_index").collect()
    numbered = captures.numbered(cut.where("path LIKE '%a.pcap'"), 97).orderBy("capture_index").collect()
    assert [r.capture_index for r in numbered] == list(range(len(one))) and [r.timestamp_ns for r in numbered] == [r.timestamp_ns for r in one]
    with pytest.raises(Exception, match="non_ip"):
        read(strict="true").count()


def test_no_capture_raises(spark, tmp_path):
    captures.register(spark)
    (tmp_path / "x.pcap").write_bytes(b"not a capture at all, but long enough")
    with pytest.raises(Exception, match="not a classic capture"):
        spark.read.format("capture").load(str(tmp_path)).count()


def test_raw_candidates(spark, folder):
    packets = pcap.read_packets(spark, str(folder / "a.pcap"), payload=True).where("capture_index < 9")
    got = {r.first_index: r for r in L.raw_candidates(P.sessions(packets)).collect()}
    web, dns, ftp, loop = got[0], got[4], got[6], got[8]
    assert web.asDict().keys() >= set(L.RAW) and len(L.RAW) == 34
    assert (web.proto, web.service, web.state, web.spkts, web.dpkts, web.sttl, web.dttl) == ("tcp", "http", "LOCAL_ESTABLISHED", 2, 2, 64, 64)
    assert (web.swin, web.dwin, web.stcpb, web.dtcpb, web.trans_depth, web.response_body_len, web.ct_flw_http_mthd) == (4096, 2048, 100, 900, 1, 5, 1)
    assert (web.synack, web.ackdat, web.dur) == pytest.approx((0.2, 0.1, 0.4)) and web.tcprtt == pytest.approx(0.3)
    assert web.rate == pytest.approx(10) and web.sloss is web.dloss is None and web.is_ftp_login is None and web.is_sm_ips_ports == 0
    assert (dns.proto, dns.service, dns.state, dns.synack, dns.swin, dns.rate, dns.dmean, dns.dttl, dns.sinpkt) == ("udp", None, None, None, None, None, None, None, 0)
    assert (ftp.service, ftp.ct_ftp_cmd, ftp.is_ftp_login, ftp.state) == ("ftp", 1, True, "LOCAL_OTHER")
    assert (loop.state, loop.is_sm_ips_ports) == ("LOCAL_RST", 1)
    assert L.raw_candidates(P.sessions(packets.limit(0))).count() == 0
