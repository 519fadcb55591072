"""Manifests, configs and environment files, read and checked on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class TextSource:
    dataset: str
    config: str | None = None
    split: str = "train"
    text_column: str = "text"
    limit: int | None = None
    weight: float | None = None


@dataclass(frozen=True)
class ChatSource:
    dataset: str
    split: str = "train"
    format: str = "alpaca"
    messages_column: str = "conversations"
    instruction_column: str = "instruction"
    input_column: str = "input"
    output_column: str = "output"
    limit: int | None = None


def _entries(value: Any, kind: str) -> list[dict]:
    if not isinstance(value, list) or not value:
        raise ValueError(f"{kind} manifest must be a non-empty array")
    for i, x in enumerate(value, 1):
        if not isinstance(x, dict) or not isinstance(x.get("dataset"), str):
            raise ValueError(f"source {i} needs a dataset")
    return value


def _known(entry: dict, cls: type) -> dict:
    return {k: v for k, v in entry.items() if k in cls.__dataclass_fields__}


def text_sources(value: Any) -> list[TextSource]:
    """A manifest of text sources."""
    found = []
    for i, x in enumerate(_entries(value, "text source"), 1):
        source = TextSource(**_known(x, TextSource))
        if not isinstance(source.split, str) or not isinstance(source.text_column, str):
            raise ValueError(f"source {i}: split and text_column must be strings")
        if source.limit is not None and (isinstance(source.limit, bool) or not isinstance(source.limit, int) or source.limit <= 0):
            raise ValueError(f"source {i}: limit must be a positive whole number")
        found.append(source)
    return found


def chat_sources(value: Any) -> list[ChatSource]:
    """S3: a manifest of chat sources."""
    found = []
    for i, x in enumerate(_entries(value, "chat source"), 1):
        source = ChatSource(**_known(x, ChatSource))
        if source.format not in ("alpaca", "conversations"):
            raise ValueError(f"source {i}: format must be alpaca or conversations")
        found.append(source)
    return found


def training_mix(path: str) -> list[tuple[str, float]]:
    """(path, share) of token tables; paths are relative to the manifest, shares add up to 1."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, list) or not value:
        raise ValueError("training manifest must be a non-empty array")
    for x in value:
        if not isinstance(x, dict) or not isinstance(x.get("path"), str) or isinstance(x.get("weight"), bool) or not isinstance(x.get("weight"), (int, float)) or x["weight"] <= 0:
            raise ValueError("each training source needs a path and a positive weight")
    total = sum(x["weight"] for x in value)
    return [(str(Path(path).parent / x["path"]), x["weight"] / total) for x in value]


def load_json(path: str) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def json_config(path: str, allowed: Iterable[str]) -> dict[str, Any]:
    """A JSON object without unknown keys."""
    value = load_json(path)
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold an object")
    if unknown := sorted(set(value) - set(allowed)):
        raise ValueError(f"{path} has unknown keys: {', '.join(unknown)}")
    return value


def overlay(defaults: dict[str, Any], config: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """A config's values over the defaults, and what the caller has given over both."""
    return {**defaults, **config, **{k: v for k, v in given.items() if v is not None}}


def load_env(path: str = ".env") -> dict[str, str]:
    """Sets the file's NAME=value lines (quotes go) that the environment doesn't have; returns those that it set."""
    file, added = Path(path), {}
    if not file.is_file():
        return added
    for line in file.read_text(encoding="utf-8").splitlines():
        name, found, value = line.strip().partition("=")
        name = name.strip()
        if not found or not name or name.startswith("#") or name in os.environ:
            continue
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        os.environ[name] = added[name] = value
    return added
