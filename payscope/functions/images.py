"""What image bytes say of themselves in their first bytes; pixels are not looked at."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def header_of(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(kind, width, height) of png, gif, ico and svg data; of an ico the largest picture (0 stands for 256)."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data[:4] == b"\0\0\1\0" and len(data) >= 6:
        entries = [data[6 + 16 * k : 8 + 16 * k] for k in range(int.from_bytes(data[4:6], "little"))]
        sizes = [(e[0] or 256, e[1] or 256) for e in entries if len(e) == 2]
        return ("ico", *max(sizes, key=lambda s: s[0] * s[1])) if sizes else ("ico", None, None)
    if b"<svg" in data[:3000].lower():
        return "svg", None, None
    return None, None, None


@F.pandas_udf(SCHEMA)  # type: ignore[call-overload]
def image_header(data: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([header_of(d) for d in data], columns=SCHEMA.names)
    return rows.astype({"width": "Int32", "height": "Int32"})
