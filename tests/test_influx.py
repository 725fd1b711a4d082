"""Annotated CSV, line protocol and a live server."""

from __future__ import annotations

import re
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from rillscope.sources import influx_lines, read_influx, read_path
from rillscope.sources.influx_server import read_server, rows_of

ANNOTATED = '''\
#datatype,string,long,dateTime:RFC3339,dateTime:RFC3339,dateTime:RFC3339,double,string,string,string
#group,false,false,true,true,false,false,true,true,true
#default,_result,,,,,,,,here
,result,table,_start,_stop,_time,_value,_field,_measurement,source
,,0,2017-12-01T00:00:00Z,2017-12-02T00:00:00Z,2017-12-01T16:00:10Z,35.5,rtt,ping,a
,,0,2017-12-01T00:00:00Z,2017-12-02T00:00:00Z,2017-12-01T16:00:11.5Z,36.25,rtt,ping,"b, c"
,,0,2017-12-01T00:00:00Z,2017-12-02T00:00:00Z,2017-12-01T16:00:12.123456789Z,37,rtt,ping,
,,0,2017-12-01T00:00:00Z,2017-12-02T00:00:00Z,not a time,37,rtt,ping,a
,,0,2017-12-01T00:00:00Z,2017-12-02T00:00:00Z,2017-12-01T16:00:13Z,,rtt,ping,a

#datatype,string,long,dateTime:number,long,string
#group,false,false,false,false,true
#default,_result,,,,
,result,table,_time,latency,source
,,1,1512144020000000000,40,"say ""hi"""
,,1,1512144021000000000,forty,z
,,1,1512144022000000000

error,reference
Failed to parse query,897

,result,table,_time,_value
,,2,2017-12-01T17:00:30+01:00,50
'''

PROTOCOL = r"""# DDL
CREATE DATABASE x
ping,source=a,destination=b\,c rtt=35.5,note="x, y=1 z" 1512144010000000000
ping,source=a rtt=36i 1512144011000000000
my\ ping,tag\ one=v\=1 other=1,latency=37u 1512144012000000000
ping,source=a note="no number" 1512144013000000000
ping,source=a rtt=38
ping,source=a rtt=t 1512144013000000000
ping rtt=39 1512144014123456789
"""


def samples(df):
    return sorted((r.epoch_us - 1_512_144_000_000_000, r.rtt_value) for r in df.collect())


def test_annotated(spark, tmp_path):
    (tmp_path / "x.influx").write_text(ANNOTATED)
    want = [(10_000_000, 35.5), (11_500_000, 36.25), (12_123_456, 37.0), (20_000_000, 40.0), (30_000_000, 50.0)]
    assert samples(read_path(spark, f"{tmp_path}/x.influx")) == want
    rows = {r.seq: r for r in influx_lines(spark, f"{tmp_path}/x.influx").collect()}
    ordered = [rows[k] for k in sorted(rows)]
    assert [r.broken for r in ordered] == [None, None, None, "time", "value", None, "value", "fields", "error table", None]
    assert [(r.tags or {}).get("source") for r in ordered] == ["a", "b, c", "here", None, None, 'say "hi"', None, None, None, None]
    with pytest.raises(ValueError, match="broken line"):
        read_influx(spark, f"{tmp_path}/x.influx", "strict")
    names = {r.series_id for r in read_influx(spark, f"{tmp_path}/x.influx", series="*").collect()}
    assert "_field=rtt,_measurement=ping,source=a" in names and "" in names


def test_header_far_before_a_split(spark, tmp_path):
    head = ANNOTATED.split("\n")[:4]
    at = lambda i: datetime.fromtimestamp(1_512_144_000 + i, UTC).isoformat().replace("+00:00", "Z")
    one = [f",,0,,,{at(i)},{1 + i % 7},rtt,ping,a" for i in range(3000)]
    two = [f",,1,{(1_512_144_000 + i) * 10**9},{2 + i % 5},b" for i in range(3000, 4000)]
    (tmp_path / "long.csv").write_text("\r\n".join([*head, *one, "", "#datatype,string,long,dateTime:number,long,string", ",result,table,_time,latency,source", *two, ""]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = read_influx(spark, f"{tmp_path}/long.csv", series="source")
        assert spark.read.text(f"{tmp_path}/long.csv").rdd.getNumPartitions() > 10
        got = sorted((r.series_id, r.epoch, r.rtt_value) for r in df.collect())
        order = [r.epoch for r in df.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("a", 1_512_144_000.0 + i, 1.0 + i % 7) for i in range(3000)] + [("b", 1_512_144_000.0 + i, 2.0 + i % 5) for i in range(3000, 4000)]
    assert order == sorted(order)


def test_line_protocol(spark, tmp_path):
    (tmp_path / "x.lp").write_text(PROTOCOL)
    assert samples(read_path(spark, f"{tmp_path}/x.lp", "influx")) == [(10_000_000, 35.5), (11_000_000, 36.0), (12_000_000, 37.0), (14_123_456, 39.0)]
    rows = influx_lines(spark, f"{tmp_path}/x.lp").orderBy("seq").collect()
    assert [r.broken for r in rows] == ["line", None, None, None, "value", "time", "value", None]
    assert rows[1].tags == {"_measurement": "ping", "source": "a", "destination": "b,c"} and rows[3].tags == {"_measurement": "my ping", "tag one": "v=1"}
    (tmp_path / "s.lp").write_text("ping rtt=5 1512144010\n")
    assert samples(read_influx(spark, f"{tmp_path}/s.lp", precision="s")) == [(10_000_000, 5.0)]
    (tmp_path / "none.lp").write_text("")
    assert read_influx(spark, f"{tmp_path}/none.lp").count() == 0


class _Server(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        query = self.rfile.read(int(self.headers["Content-Length"])).decode()
        start, stop = (datetime.fromisoformat(t).timestamp() for t in re.search(r"start: (\S+), stop: (\S+)\)", query).groups())
        self.asked.append((start, stop, self.headers["Authorization"], self.path))
        seconds = [s for s in range(1_512_144_000, 1_512_144_100, 10) if start <= s < stop]
        body = "#default,_result,,,,\n,result,table,_time,_value,source\n" + "".join(f",,0,{datetime.fromtimestamp(s, UTC).isoformat()},{s % 97}.5,a\n" for s in seconds)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


def test_live_server(spark):
    server = HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = read_server(spark, series="source", url=f"http://127.0.0.1:{server.server_port}", org="o", token="t", query="from(bucket: 'b') |> range(start: {start}, stop: {stop})", start=1_512_144_000, stop=1_512_144_100, parts=4)
        assert df.rdd.getNumPartitions() == 4
        assert sorted((r.epoch, r.rtt_value, r.series_id) for r in df.collect()) == [(float(s), s % 97 + 0.5, "a") for s in range(1_512_144_000, 1_512_144_100, 10)]
    finally:
        server.shutdown()
    assert {a[2:] for a in _Server.asked} == {("Token t", "/api/v2/query?org=o")} and len({a[:2] for a in _Server.asked}) == 4
    with pytest.raises(Exception, match="options are missing"):
        read_server(spark, url="http://127.0.0.1:1").count()


def test_other_transport(spark):
    df = read_server(spark, transport="tests.test_influx:archive", query="{start} {stop}", start=0, stop=100, parts=5)
    assert sorted((r.epoch, r.rtt_value) for r in df.collect()) == [(20.0 * k, 5.0) for k in range(5)]
    with pytest.raises(ValueError, match="server answers"):
        list(rows_of(["error,reference\n", "bad,1\n"]))


def archive(options, query):
    start = query.split()[0]
    return [",result,table,_time,rtt\n", f",,0,{start},5\n", f",,0,{start},broken\n"]
