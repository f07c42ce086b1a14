"""Expressions over packets."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.dimensions import FLAG_BITS, PROTOCOLS, SERVICE_PORTS


def protocol_name(number: Column) -> Column:
    """The protocol's name in upper case, PROTO_n for one that isn't known."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(PROTOCOLS.items())])
    return F.upper(F.coalesce(names[number.cast("int")], F.concat(F.lit("PROTO_"), number.cast("string"))))


def _is_service(port: Column) -> Column:
    return port.isin(*SERVICE_PORTS)


def direction(src: Column, dst: Column) -> Column:
    """inbound from a service, outbound to one or to a port that may be one, unknown else."""
    return (
        F.when((src < 0) & (dst < 0), "unknown").when(_is_service(src), "inbound").when(_is_service(dst), "outbound").when((src < 1024) | (dst >= 1024), "outbound").otherwise("unknown")
    )


def server_port(src: Column, dst: Column) -> Column:
    """The port of the service, -1 where there is none."""
    loose = F.when((src < 1024) | (dst >= 1024), F.greatest(dst, F.lit(-1))).otherwise(-1)
    return F.when((src < 0) & (dst < 0), -1).when(_is_service(src), src).when(_is_service(dst), dst).otherwise(loose)


def flag(bits: Column, name: str) -> Column:
    return (bits.bitwiseAND(F.lit(FLAG_BITS[name]).cast("long")) != 0).cast("int")


def request_bytes(way: Column, payload: Column) -> Column:
    return F.when(way == "outbound", payload).otherwise(0)


def response_bytes(way: Column, payload: Column) -> Column:
    return F.when(way == "inbound", payload).otherwise(0)


def entropies(data: list[bytes], rows: int = 4096) -> np.ndarray:
    """Shannon entropy in bits of each text's bytes, by one count of bytes for many texts; 0 for none."""
    out = np.zeros(len(data))
    for lo in range(0, len(data), rows):
        part = data[lo : lo + rows]
        sizes = np.array([len(x) for x in part])
        of = np.repeat(np.arange(len(part)), sizes)
        p = np.bincount(of * 256 + np.frombuffer(b"".join(part), np.uint8), minlength=256 * len(part)).reshape(len(part), 256) / np.maximum(sizes, 1)[:, None]
        out[lo : lo + rows] = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(1) + 0.0
    return out


def entropy_of(data: bytes) -> float:
    return float(entropies([data or b""])[0])


@F.pandas_udf(DoubleType())  # a type, not its name: workers import this module without a session
def byte_entropy(data: pd.Series) -> pd.Series:
    return pd.Series(entropies([x.encode() if isinstance(x, str) else bytes(x or b"") for x in data]), dtype=float)
