"""Mappings kept between sessions: encrypted namespaces, and records that expire."""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable, Iterator
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.durable import Files

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")
TTL_SECONDS = 30 * 24 * 3600


def encrypted(x: Column, key: bytes) -> Column:
    return F.aes_encrypt(x, F.lit(key), F.lit("GCM"))


def decrypted(x: Column, key: bytes) -> Column:
    """Null where the key is not the one."""
    return F.try_aes_decrypt(x, F.lit(key), F.lit("GCM")).cast("string")


class Namespace:
    """A named mapping under a root folder; originals and keys are stored encrypted.

    The folder may lie in any store that Spark writes to. A save writes its rows to a
    folder of their own and then claims the next version, and fails if another writer
    has claimed it since this one loaded, so no number is given out twice.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        if not NAME.fullmatch(name):
            raise ValueError(f"not a namespace name: {name!r}")
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"
        self.files = Files(spark, self.path)
        self.version: int | None = None

    def key(self, create: bool = False) -> bytes:
        if create:
            self.files.create(f"{self.path}/key", secrets.token_bytes(32))
        return self.files.read(f"{self.path}/key")

    def _stored(self) -> tuple[int, str]:
        """The last version that was claimed and the folder that it names."""
        claims = {int(x[6:]): x for x in self.files.names(self.path) if x.startswith("claim-")}
        return (max(claims), self.files.read(f"{self.path}/{claims[max(claims)]}").decode()) if claims else (0, "")

    def load(self) -> DataFrame | None:
        """The mapping, or none if nothing was saved. A wrong key is an error."""
        self.version, folder = self._stored()
        if not self.version:
            return None
        key = self.key()
        rows = self.spark.read.parquet(f"{self.path}/{folder}")
        plain = rows.select("pseudonym", decrypted(F.col("original"), key).alias("original"), decrypted(F.col("lookup_key"), key).alias("lookup_key"), "label", "n")
        if plain.where("original IS NULL").limit(1).count():
            raise ValueError("the key does not open this namespace")
        return plain

    def save(self, mapping: DataFrame) -> None:
        key, (seen, _) = self.key(create=True), self._stored()
        if seen != (self.version or 0):
            raise RuntimeError("another writer has saved this namespace")
        folder = f"rows-{secrets.token_hex(8)}"
        rows = mapping.select("pseudonym", encrypted(F.col("original"), key).alias("original"), encrypted(F.col("lookup_key"), key).alias("lookup_key"), "label", "n")
        rows.write.parquet(f"{self.path}/{folder}")
        if not self.files.create(f"{self.path}/claim-{seen + 1}", folder.encode()):
            self.files.delete(f"{self.path}/{folder}")
            raise RuntimeError("another writer has saved this namespace")
        self.version = seen + 1
        # the version before this one stays, as other sessions may still read it
        old = f"{self.path}/claim-{seen - 1}"
        if seen > 1 and self.files.exists(old):
            self.files.delete(f"{self.path}/{self.files.read(old).decode()}")

    def delete(self) -> bool:
        return self.files.delete(self.path)


def namespaces(spark: SparkSession, root: str) -> list[str]:
    found = Files(spark, root)
    return [x for x in found.names(root) if found.exists(f"{root.rstrip('/')}/{x}/key")]


@runtime_checkable
class Backend(Protocol):
    """Where records are kept: key, value (bytes), expires_at (null: never)."""

    def put(self, rows: DataFrame) -> None: ...

    def rows(self) -> DataFrame: ...

    def delete(self, key: str) -> None: ...

    def ping(self) -> bool: ...


class MemoryBackend:
    def __init__(self, spark: SparkSession):
        self.spark, self.records = spark, {}

    def put(self, rows: DataFrame) -> None:
        self.records |= {r["key"]: (bytes(r["value"]), r.expires_at) for r in rows.collect()}

    def rows(self) -> DataFrame:
        return self.spark.createDataFrame([(k, bytearray(v), e) for k, (v, e) in self.records.items()], "key string, value binary, expires_at timestamp")

    def delete(self, key: str) -> None:
        self.records.pop(key, None)

    def ping(self) -> bool:
        return True


class ParquetBackend:
    """Records appended to a folder; the latest of a key counts, and a null value deletes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark, path)

    def put(self, rows: DataFrame) -> None:
        rows.select("key", "value", "expires_at", F.current_timestamp().alias("written_at")).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        if not self.files.exists(self.path):
            return self.spark.createDataFrame([], "key string, value binary, expires_at timestamp")
        latest = self.spark.read.parquet(self.path).groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), "written_at").alias("x"))
        return latest.select("key", "x.*").where("value IS NOT NULL")

    def delete(self, key: str) -> None:
        self.put(self.spark.createDataFrame([(key, None, None)], "key string, value binary, expires_at timestamp"))

    def ping(self) -> bool:
        """Whether the folder's store answers."""
        try:
            self.files.exists(self.path)
        except Exception:
            return False
        return True


class ClientBackend:
    """Records in a key-value server that expires them itself.

    connect() makes a client in each task that needs one, with set(key, value, ex=seconds or
    None), get(key), delete(key), ttl(key) (negative: none), scan_iter(pattern) and ping(),
    as the usual clients of such servers have them.
    """

    def __init__(self, spark: SparkSession, connect: Callable[[], Any], pattern: str = "mapping:*"):
        self.spark, self.connect, self.pattern = spark, connect, pattern

    def put(self, rows: DataFrame) -> None:
        connect = self.connect

        def send(part):
            client = connect()
            for r in part:
                client.set(r["key"], bytes(r["value"]), ex=r["seconds"])

        seconds = F.when(F.col("expires_at").isNotNull(), F.greatest(F.unix_seconds("expires_at") - F.unix_seconds(F.current_timestamp()), F.lit(1)))
        rows.select("key", "value", seconds.cast("int").alias("seconds")).foreachPartition(send)

    def rows(self) -> DataFrame:
        connect = self.connect
        named = lambda key: key.decode() if isinstance(key, bytes) else key
        keys = self.spark.createDataFrame([(named(k),) for k in connect().scan_iter(self.pattern)], "key string")

        def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = connect()
            for frame in frames:
                got = [(k, client.get(k), client.ttl(k)) for k in frame["key"]]
                yield pd.DataFrame([(k, v, float(t)) for k, v, t in got if v is not None], columns=["key", "value", "ttl"])

        found = keys.mapInPandas(fetch, "key string, value binary, ttl double")
        return found.select("key", "value", F.when(F.col("ttl") >= 0, F.timestamp_seconds(F.unix_seconds(F.current_timestamp()) + F.col("ttl").cast("long"))).alias("expires_at"))

    def delete(self, key: str) -> None:
        self.connect().delete(key)

    def ping(self) -> bool:
        try:
            return bool(self.connect().ping())
        except Exception:
            return False


def live(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Records that have not expired."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > (F.current_timestamp() if now is None else now)))


def expiry(now: Column, ttl_seconds: Column) -> Column:
    """When a record ends; never for a time to live of zero or less."""
    return F.when(ttl_seconds > 0, F.timestamp_micros(F.unix_micros(now) + ttl_seconds.cast("long") * 1_000_000))


class MappingStore:
    """Mappings by request, encrypted, with a time to live."""

    def __init__(self, backend: Backend, key: bytes, ttl_seconds: int = TTL_SECONDS):
        self.backend, self.key, self.ttl = backend, key, ttl_seconds

    def save(self, requests: DataFrame) -> None:
        """requests: (request_id, tenant_id, mappings map<string,string>); empty mappings are not kept."""
        now = F.current_timestamp()
        value = F.to_json(F.struct("request_id", "tenant_id", now.alias("created_at"), "mappings"))
        self.backend.put(requests.where(F.size("mappings") > 0).select(F.concat(F.lit("mapping:"), "request_id").alias("key"), encrypted(value, self.key).alias("value"), expiry(now, F.lit(self.ttl)).alias("expires_at")))

    def load(self) -> DataFrame:
        """request_id, tenant_id, created_at, mappings, ttl_seconds (null: never) of the live records that the key opens."""
        schema = "request_id string, tenant_id string, created_at timestamp, mappings map<string,string>"
        rows = live(self.backend.rows()).select(F.from_json(decrypted(F.col("value"), self.key), schema).alias("x"), (F.unix_seconds("expires_at") - F.unix_seconds(F.current_timestamp())).alias("ttl_seconds"))
        return rows.where("x.request_id IS NOT NULL").select("x.*", "ttl_seconds")

    def delete(self, request_id: str) -> None:
        self.backend.delete(f"mapping:{request_id}")
