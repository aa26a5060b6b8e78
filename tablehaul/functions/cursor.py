"""Resume cursors: a JSON array of {type, value}, one for each key column."""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
from collections.abc import Sequence


def _time(text: str) -> dt.datetime:
    m = re.fullmatch(r"(.*T\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)", text)
    if not m:
        raise ValueError(f"bad time {text!r} in a cursor")
    zone = "+00:00" if m[3] == "Z" else m[3]
    return dt.datetime.fromisoformat(f"{m[1]}.{(m[2] or '0').ljust(6, '0')[:6]}{zone}")


DECODE = {
    "bytes": base64.b64decode, "string": str, "int64": int, "uint64": int, "float64": float, "time": _time,
    "bool": lambda x: {"true": True, "false": False}[x],
}


def _one(v) -> dict[str, str]:
    if v is None:
        raise ValueError("a key column is null; it can't be resumed from")
    if isinstance(v, bool):
        return {"type": "bool", "value": str(v).lower()}
    if isinstance(v, int):
        if not -(2**63) <= v < 2**64:
            raise ValueError(f"{v} is outside 64 bits")
        return {"type": "int64" if v < 2**63 else "uint64", "value": str(v)}
    if isinstance(v, float):
        return {"type": "float64", "value": repr(v)}
    if isinstance(v, (bytes, bytearray)):
        return {"type": "bytes", "value": base64.b64encode(bytes(v)).decode()}
    if isinstance(v, dt.datetime):
        v = v if v.tzinfo else v.replace(tzinfo=dt.UTC)
        return {"type": "time", "value": v.isoformat().replace("+00:00", "Z")}
    if isinstance(v, str):
        return {"type": "string", "value": v}
    raise TypeError(f"no cursor form for {type(v).__name__}")


def encode(values: Sequence) -> str:
    return json.dumps([_one(v) for v in values], ensure_ascii=False)


def decode(text: str) -> list | None:
    """None for an empty text: there is no cursor."""
    if not text:
        return None
    try:
        return [DECODE[x["type"]](x["value"]) for x in json.loads(text)]
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"bad cursor {text!r}: {e}") from None
