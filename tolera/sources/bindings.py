"""Parameters as JSON: arrays become data URIs of compressed numpy archives, other values stay as they are."""

from __future__ import annotations

import base64
import io
from typing import Any

import numpy as np

PREFIX = "data:application/x-npz;base64,"


def to_json(value: Any) -> Any:
    """Arrays anywhere inside dicts and lists as text; numpy scalars as numbers."""
    if isinstance(value, dict):
        return {k: to_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_json(v) for v in value]
    if isinstance(value, np.ndarray):
        out = io.BytesIO()
        np.savez_compressed(out, array=value)
        return PREFIX + base64.b64encode(out.getvalue()).decode()
    if isinstance(value, np.generic):
        return value.item()
    return value


def from_json(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: from_json(v) for k, v in value.items()}
    if isinstance(value, list):
        return [from_json(v) for v in value]
    if isinstance(value, str) and value.startswith(PREFIX):
        with np.load(io.BytesIO(base64.b64decode(value[len(PREFIX) :])), allow_pickle=False) as z:
            return z["array"]
    return value
