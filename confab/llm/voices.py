"""Canonical speakers: which voice of a recording a loosely spelt speaker field means."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
NUMBERED = re.compile(r"^(?:speaker|spk|s)\s*0*(\d+)$")
ALIAS_TYPE = "map<string,string>"
UNNAMED = "*"
ROLES = ("host", "guest", "unknown")


def voice_key(raw: str | None) -> str | None:
    """A speaker's spelling without case, punctuation, brackets and order-free padding; None where nothing is left."""
    if raw is None:
        return None
    key = " ".join(WORD.findall(unicodedata.normalize("NFKC", raw).lower().replace("_", " ")))
    m = NUMBERED.match(key)
    return f"#{int(m[1])}" if m else key or None


def alias_keys(label: str, role: str | None, names: list[str]) -> set[str]:
    """Every key under which a speaker may appear."""
    keys = {voice_key(label)}
    if role and role != "unknown":
        keys.add(voice_key(role))
    for name in names:
        parts = (voice_key(name) or "").split()
        if not parts:
            continue
        keys |= {" ".join(parts), parts[0], parts[-1]}
        if len(parts) > 1:
            first, last = " ".join(parts[:-1]), parts[-1]
            keys |= {f"{last} {first}", f"{parts[0][0]} {last}", f"{last} {parts[0][0]}"}
    return keys - {None, ""}


def aliases_of(people: list[tuple[str, str | None, str | None]], host: str | None, guest: str | None) -> dict[str, str]:
    """alias key -> label for one recording; keys that more than one speaker has are left out.

    people: (label, role, display name). The recording's host and guest names also name the speakers of those roles,
    and a speaker of unknown role whose name is the host's or guest's has that role.
    """
    by_role = {"host": host, "guest": guest}
    named = {voice_key(name) for _, _, name in people} - {None}
    # A manifest name that is no speaker's display name belongs to the one nameless speaker of its role.
    nameless: dict[str, list[str]] = {}
    for label, role, name in people:
        if not voice_key(name):
            nameless.setdefault(role or "unknown", []).append(label)
    given: dict[str, str] = {}
    for role, name in by_role.items():
        if voice_key(name) and voice_key(name) not in named and len(nameless.get(role, ())) == 1:
            given[nameless[role][0]] = name
    owners: dict[str, set[str]] = {}
    taken = {role for _, role, _ in people if role and role != "unknown"}
    for label, role, name in people:
        names = [n for n in (name, given.get(label)) if n]
        if (not role or role == "unknown") and names:
            role = next((r for r, n in by_role.items() if n and r not in taken and voice_key(n) == voice_key(names[0])), role)
        for key in alias_keys(label, role, names):
            owners.setdefault(key, set()).add(label)
    out = {key: next(iter(labels)) for key, labels in owners.items() if len(labels) == 1}
    unnamed = [label for label, _, name in people if not voice_key(name) and label not in given]
    if len(unnamed) == 1 and len(people) > 1:
        out[UNNAMED] = unnamed[0]  # a strange name can only be this speaker's
    return out


def alias_maps(speakers: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(file_id, aliases map<key, label>), one row a recording.

    A recording has few speakers, so its row is small; repeated speaker rows count once. Rows without file_id or label
    take no part.
    """
    people = (
        speakers.where("file_id is not null and label is not null")
        .groupBy("file_id")
        .agg(F.sort_array(F.collect_set(F.struct("label", F.lower(F.trim("role")).alias("role"), F.col("display_name").alias("name")))).alias("people"))
    )
    if manifest is not None:
        people = people.join(
            manifest.where("file_id is not null").groupBy("file_id").agg(F.max("speakers.host").alias("host"), F.max("speakers.guest").alias("guest")), "file_id", "left"
        )
    else:
        people = people.withColumns({"host": F.lit(None).cast("string"), "guest": F.lit(None).cast("string")})

    @F.pandas_udf(ALIAS_TYPE)
    def build(people, host, guest):  # noqa: ANN001
        return pd.Series(
            [
                aliases_of([(p["label"], p["role"], p["name"]) for p in ps], h if isinstance(h, str) else None, g if isinstance(g, str) else None)
                for ps, h, g in zip(people, host, guest)
            ],
            dtype=object,
        )

    return people.select("file_id", build("people", "host", "guest").alias("aliases"))


def resolver(aliases: dict[str, str] | list | None):
    """A function from spellings to labels; spellings that fit no alias keep their key as a voice of its own."""
    known, cache = dict(aliases or {}), {}

    def resolve(raw: str | None) -> str | None:
        if raw not in cache:
            key = voice_key(raw) if isinstance(raw, str) else None
            strange = None if key is None or key[0] == "#" or key in ROLES else known.get(UNNAMED)
            cache[raw] = None if key is None else known.get(key) or strange or "?" + key
        return cache[raw]

    return resolve
