"""Index catalogs of other layouts: key:value text and the older fixed-width binary."""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession

#: The keys of a text catalog, in order (fixed values).
KEYS = ["nb_monotig", "k", "record_option", "nb_eq_class", "nb_colors", "do_query_on_disk"]
#: Record options (fixed values).
OPTIONS = {0: "presence", 1: "exact", 2: "quantized", 3: "log"}


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def parse_info(text: str) -> dict:
    """The keys as integers, and datasets: a list of (name, total_kmers). Wrong keys or numbers raise a ValueError."""
    lines = [x for x in text.splitlines() if x.strip()]
    out: dict = {}
    for key, line in zip(KEYS, lines):
        name, _, value = line.rpartition(":")
        if name != key:
            raise ValueError(f"expected {key}, found {line!r}")
        out[key] = int(value)
    if len(out) < len(KEYS):
        raise ValueError("the catalog ends early")
    out["datasets"] = [(n, int(t)) for n, _, t in (x.rpartition(":") for x in lines[len(KEYS) :])]
    if len(out["datasets"]) != out["nb_colors"]:
        raise ValueError(f"{out['nb_colors']} datasets are named, {len(out['datasets'])} listed")
    return out


def format_info(info: dict) -> str:
    return "".join(f"{k}:{int(info[k])}\n" for k in KEYS) + "".join(f"{n}:{t}\n" for n, t in info["datasets"])


#: Fields of the binary catalog: little-endian u64, u32, u32, i64, u64 and a flag byte.
_BINARY = struct.Struct("<QIIqQ?")


def parse_binary(raw: bytes) -> dict:
    """The keys of a binary catalog; older files end before the flag, which then is True."""
    if len(raw) < _BINARY.size - 1:
        raise ValueError("the catalog ends early")
    values = _BINARY.unpack(raw[: _BINARY.size].ljust(_BINARY.size, b"\x01"))
    return dict(zip(KEYS, (int(v) for v in values))) | {"datasets": []}


def is_binary(raw: bytes) -> bool:
    return any(b < 9 for b in raw[:64])


def read_info(spark: SparkSession, path: str) -> dict:
    """A catalog of either layout."""
    raw = _bytes(spark, path)
    return parse_binary(raw) if is_binary(raw) else parse_info(raw.decode())


def upgrade_info(spark: SparkSession, path: str, datasets) -> dict:
    """A text catalog's content from an old one and datasets(dataset_id, name, total_kmers)."""
    info = read_info(spark, path)
    rows = datasets.select("name", "total_kmers").orderBy("dataset_id").collect()
    return info | {"nb_colors": len(rows), "datasets": [(r["name"], r["total_kmers"]) for r in rows]}
