"""Rules of ordered streams without a stream, the liveness stream against its batch twin, and the stored baseline."""

import json

from pyspark.sql import functions as F

from netsift.operators import drift as I
from netsift.plans import views as V
from netsift.sources import baseline as stored
from netsift.streaming.flows import FlowFold
from netsift.streaming.liveness import Silence


def fold(rule, events):
    """What the processor does with the events of one key once the watermark is past all of them."""
    state, out = None, []
    for event in sorted(events):
        if state is not None and rule.deadline(state) < event[0]:
            out, state = out + rule.close(state), None
        state, emitted = rule.step(state, event)
        out += emitted
        state = json.loads(json.dumps(state))
    return out + (rule.close(state) if state is not None else [])


def test_silence_ends_an_interval():
    events = [(0, 1, "heartbeat"), (5, 2, "connect"), (9, 3, "heartbeat"), (19, 4, "connect"), (30, 5, "heartbeat"), (31, 6, "disconnect"), (50, 7, "connect"), (52, 8, "disconnect"), (53, 9, "connect")]
    assert fold(Silence(10), events) == [(5, 29), (50, 52), (53, 63)]
    assert fold(Silence(11), events) == [(5, 31), (50, 52), (53, 64)]
    assert fold(Silence(10), []) == [] and fold(Silence(10), [(1, 1, "disconnect"), (2, 2, "heartbeat")]) == []


def test_a_flow_is_folded_packet_by_packet():
    # micros, seq_no, ts, from_lo, length, ttl, window, tcp_seq, flags, state, http, login, ftp
    packets = [(1_000_000, 1, 1.0, True, 40, 64, 100, 0, 0x02, "ACC", False, False, False), (1_200_000, 2, 1.2, False, 60, 63, 200, 77, 0x12, "ACC", False, False, False),
               (1_500_000, 3, 1.5, True, None, None, None, 5, 0x10, "ACC", True, False, True), (1_900_000, 4, 1.9, True, 10, 62, 300, 6, 0x01, "FIN", False, True, True),
               (9_000_000, 5, 9.0, False, 5, 1, 1, 1, 0, "INT", False, False, False)]
    first, second = fold(FlowFold(2_000_000), packets)
    names = [p.split()[0] for p in FlowFold.OUTPUTS.split(", ")]
    got = dict(zip(names, first))
    want = {"first_lo": True, "stime": 1.0, "ltime": 1.9, "sbytes": 50, "dbytes": 60, "spkts": 3, "dpkts": 1, "sttl": 62, "dttl": 63, "swin": 300, "dwin": 200, "stcpb": 5, "dtcpb": 77,
            "state": "FIN", "ct_flw_http_mthd": 1, "is_ftp_login": 1, "ct_ftp_cmd": 2, "sintpkt": 0.45, "sjit": 0.05, "dintpkt": 0.0, "djit": 0.0, "synack": 0.2, "ackdat": 0.5}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 if isinstance(want[c], float) else got[c] == want[c] for c in want)
    assert dict(zip(names, second))["first_lo"] is False and dict(zip(names, second))["spkts"] == 1


def test_a_stored_baseline_gives_the_rows_of_the_table(spark, sf, tmp_path):
    columns = ["sbytes", "spkts", "dpkts", "stime", "service", "proto", "srcip"]
    base, live = V.baseline(spark, sf).select(*columns), V.live(spark, sf).select(*columns)
    half = F.col("spkts") % 2 == 0
    first = stored.store(base.where(half), str(tmp_path / "one"))
    both = stored.extend(base.where(~half), first, str(tmp_path / "two"))
    rounded = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert rounded(stored.compare(both, live)) == rounded(I.compare_features(base, live))
    assert rounded(stored.compare(first, live)) != rounded(I.compare_features(base, live))
