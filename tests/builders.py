"""Small event and thread tables for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EVENT_DEFAULTS = {
    "url": "/page", "cache_status": "MISS", "fastly_info_state": "MISS", "response_x_cache": "MISS", "status": 200,
    "origin_status": 200, "pop": "BMA", "server_region": "EU-East", "server_hostname": "cache-bma-1", "bot_name": "",
    "request_user_agent": "Mozilla/5.0", "client_ip": "80.239.150.21", "client_as_number": "1299",
    "client_as_name": "arelion sweden ab", "response_age": 0.0, "response_ttl": 3600.0, "is_cacheable": True,
    "fetch_action": "", "cache_location": "ORIGIN_FETCH", "shielding_used": False,
    "content_type": "text/html;charset=utf-8", "fetch_surrogate_control": "", "fetch_cache_control": "",
    "ddos_action": "", "ddos_rule": "", "malicious_flags": "", "deny_reason": "", "geo_country_code": "JP",
    "aem_service": "svc", "aem_tier": "publish", "origin_host": "www.example.com", "original_x_forwarded_for": "",
    "request_via": "", "response_vary": "", "time_start": None,
}
T0 = datetime(2026, 7, 16, 3, 25, tzinfo=timezone.utc)


def _type(v):
    if isinstance(v, bool):
        return T.BooleanType()
    if isinstance(v, int):
        return T.IntegerType()
    if isinstance(v, float):
        return T.DoubleType()
    return T.StringType()


EVENT_SCHEMA = T.StructType(
    [T.StructField("ord", T.LongType())]
    + [T.StructField(k, T.TimestampType() if k == "time_start" else _type(v)) for k, v in EVENT_DEFAULTS.items()]
)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def event(**o) -> dict:
    return {**EVENT_DEFAULTS, **o}


def events(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = EVENT_SCHEMA.fieldNames()[1:]
    return spark.createDataFrame([(i, *[r[n] for n in names]) for i, r in enumerate(rows)], EVENT_SCHEMA)


def unique_urls(n: int = 200, **o) -> list[dict]:
    return [event(url=f"/search?q={i}", pop="BMA" if i % 2 == 0 else "FRA", **o) for i in range(n)]


def stale_content(urls: int = 30, repeats: int = 10, **o) -> list[dict]:
    return [event(**{"url": f"/article/{u}", "response_ttl": 30.0, **o}) for u in range(urls) for _ in range(repeats)]


def across_pops(urls: int = 30, pops=("BMA", "FRA", "LHR", "AMS"), **o) -> list[dict]:
    return [event(**{"url": f"/article/{u}", "pop": p, **o}) for u in range(urls) for p in pops]


def bots_on_cold_pop(urls: int = 50, repeats: int = 3, pop: str = "XYZ", **o) -> list[dict]:
    return [
        event(**{"url": f"/crawl/{u}", "pop": pop, "bot_name": "Generic Bot", **o}) for u in range(urls) for _ in range(repeats)
    ]


def cold_pop_baseline(spark: SparkSession, pop: str = "XYZ", service: str = "svc") -> DataFrame:
    counts = {"BMA": 120000, "FRA": 79950, pop: 50}
    return spark.createDataFrame(
        [(service, "publish", p, n) for p, n in counts.items()], "aem_service string, aem_tier string, pop string, count bigint"
    )


def burst(n: int = 200, tail: int = 20, **o) -> list[dict]:
    head = [event(**{"url": f"/x{i % 20}", "time_start": at(0), **o}) for i in range(n)]
    return head + [event(**{"url": f"/y{i}", "time_start": at((i + 1) * 10), **o}) for i in range(tail)]


def cloud_burst(**o) -> list[dict]:
    return burst(**{"cache_status": "PASS", "status": 301, "client_as_number": "20940",
                    "client_as_name": "akamai international b.v.", **o})


def one_ip_burst(**o) -> list[dict]:
    return burst(**{"cache_status": "PASS", "status": 429, "client_ip": "203.0.113.7", "request_user_agent": "curl/8.0",
                    "client_as_name": "comcast cable", "client_as_number": "7922", **o})


def diverse_burst(n: int = 200, tail: int = 20) -> list[dict]:
    countries = ["US", "GB", "DE", "FR", "JP", "BR", "IN", "AU"]
    eyeball = {"client_as_name": "comcast cable", "client_as_number": "7922"}
    head = [
        event(url=f"/sale?x={i % 20}", client_ip=f"203.0.113.{i % 200}", request_user_agent=f"Mozilla/5.0 (build {i % 50})",
              geo_country_code=countries[i % 8], time_start=at(0), **eyeball)
        for i in range(n)
    ]
    return head + [
        event(url=f"/sale?y={i}", client_ip=f"203.0.113.{200 + i}", request_user_agent=f"Mozilla/5.0 (build {50 + i})",
              geo_country_code=countries[i % 8], time_start=at((i + 1) * 10), **eyeball)
        for i in range(tail)
    ]


def ttl_pairs(urls: int = 12, gap: float = 120, **o) -> list[dict]:
    return [event(**{"url": f"/u{u}", "time_start": at(t), **o}) for u in range(urls) for t in (0, gap)]


def service(rows: list[dict], name: str) -> list[dict]:
    """The same events under another service, so that many scenarios run in one job."""
    return [{**r, "aem_service": name} for r in rows]
