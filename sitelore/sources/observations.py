"""Sources of observations: explicit schemas, readers for tables, and a connector for live probes.

Verdicts are computed from tables.  ``ProbeSource`` is the place where live
look-ups come in: a function from a host to a record, run over host lists in
partitions, with a failed or slow probe as an empty record.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..refdata import TIMEOUTS

SCHEMAS = {
    "inputs": "input_id long, raw_domain string, raw_url string",
    "whois_obs": "domain string, whois map<string,string>, latency_ms int",
    "dns_obs": "domain string, has_a boolean, mx array<string>, latency_ms int",
    "dns_addr": "host string, addr string",
    "tls_obs": "domain string, subject struct<CN:string,O:string>, issuer struct<CN:string,O:string>, root struct<CN:string,O:string>, valid_from string, valid_to string, subjectaltname string, fingerprint256 string, serial_number string, chain_depth int, authorized boolean, auth_error string, protocol string, cipher struct<name:string,version:string>",
    "cert_edges": "fingerprint string, issuer_fingerprint string",
    "http_hops": "url string, status int, location string",
    "http_obs": "url string, final_url string, status int, redirects int, headers map<string,string>",
    "robots_obs": "domain string, scheme string, status int, body string, error string",
    "requests": "request_id long, ts timestamp, ip string, path string, query string, paid boolean, ua string, duration_ms int",
}


def read(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """An observation table with its declared schema; text formats are read permissively."""
    reader = spark.read.schema(SCHEMAS[name])
    return (reader.option("mode", "PERMISSIVE") if fmt in ("json", "csv") else reader).format(fmt).load(path)


def read_json_bodies(rows: DataFrame, body: str, schema: str, status: str = "status") -> DataFrame:
    """``rows`` with ``parsed``, or where the body isn't JSON, ``raw`` and the status."""
    return rows.withColumn("parsed", F.from_json(F.col(body), schema)).withColumn("raw", F.when(F.expr(f"try_parse_json({body})").isNull(), F.struct(F.col(body).alias("raw"), F.col(status).alias("status"))))


class _Hosts(InputPartition):
    def __init__(self, hosts: list[str]) -> None:
        self.hosts = hosts


class _ProbeReader(DataSourceReader):
    def __init__(self, probe: Callable[[str], tuple], hosts: list[str], partitions: int, kind: str, empty: tuple) -> None:
        self.probe, self.hosts, self.n, self.kind, self.empty = probe, hosts, partitions, kind, empty

    def partitions(self) -> list[InputPartition]:
        return [_Hosts(self.hosts[i :: self.n]) for i in range(min(self.n, max(1, len(self.hosts))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for host in partition.hosts:
            began = time.monotonic()
            try:
                record = self.probe(host)
            except Exception:  # noqa: BLE001  any failure of a probe is an empty record
                record = self.empty
            took = int((time.monotonic() - began) * 1000)
            yield (host, *(record if took <= TIMEOUTS[self.kind] else self.empty), took)


def probe_source(name: str, kind: str, schema: str, probe: Callable[[str], tuple], hosts: list[str], empty: tuple, partitions: int = 8) -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(cls)``, then ``spark.read.format(name).load()``."""

    class ProbeSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _ProbeReader(probe, hosts, partitions, kind, empty)

    return ProbeSource


def probe_all(hosts: DataFrame, kind: str, probe: Callable[[str], tuple], schema: str, empty: tuple) -> DataFrame:
    """The same for a DataFrame of hosts: each different host once, in the tasks that hold it."""

    def run(frames):
        import pandas as pd

        names = [x.strip().split()[0] for x in ("host string, " + schema + ", latency_ms int").split(",")]
        for frame in frames:
            out = []
            for host in frame["host"]:
                began = time.monotonic()
                try:
                    record = probe(host)
                except Exception:  # noqa: BLE001
                    record = empty
                took = int((time.monotonic() - began) * 1000)
                out.append((host, *(record if took <= TIMEOUTS[kind] else empty), took))
            yield pd.DataFrame(out, columns=names)

    return hosts.select("host").distinct().mapInPandas(run, f"host string, {schema}, latency_ms int")
