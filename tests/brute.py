"""Plain single-process versions of operators that SQL cannot express, written independently of them."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone
from fractions import Fraction
from zoneinfo import ZoneInfo


def split_cell(cell: str) -> list[tuple[int, str]]:
    """Items of a packed cell by a hand-written scanner."""
    cell = cell.strip(" ")
    if len(cell) >= 2 and cell[0] + cell[-1] in ("[]", "{}", "()"):
        cell = cell[1:-1]
    items, i, n = [], 0, len(cell)
    while True:
        while i < n and cell[i] == " ":
            i += 1
        if i < n and cell[i] in "\"'":
            quote, j, text = cell[i], i + 1, ""
            while j < n:
                if cell[j] == "\\" and j + 1 < n and cell[j + 1] == quote:
                    text, j = text + quote, j + 2
                elif cell[j] == quote and j + 1 < n and cell[j + 1] == quote:
                    text, j = text + quote, j + 2
                elif cell[j] == quote:
                    break
                else:
                    text, j = text + cell[j], j + 1
            i = j + 1
            while i < n and cell[i] == " ":
                i += 1
        else:
            j = i
            while j < n and (cell[j].isalnum() or cell[j] in "_-. "):
                j += 1
            text, i = cell[i:j].strip(" "), j
        items.append(text)
        if i >= n:
            break
        i += 1
        if i == n:
            items.append("")
            break
    return [(k, t) for k, t in enumerate(items) if t]


ZONES = {"UTC": 0, "GMT": 0, "Z": 0, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5}
MONTH = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


def instant(raw: str | None, zone: str | None, day_order: str | None) -> int | None:
    """Microseconds of a text, by a Python parser of the forms in the test tables."""
    raw = (raw or "").strip(" ")
    if re.fullmatch(r"\d+(\.\d+)?", raw):
        value = Fraction(raw)
        for scale in (1, 10**3, 10**6, 10**9):
            if datetime(2001, 1, 1, tzinfo=timezone.utc).timestamp() <= value / scale < datetime(2101, 1, 1, tzinfo=timezone.utc).timestamp():
                return int(value * 10**6 / scale)
        return None
    clock = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(:(?P<s>\d\d)([.,](?P<f>\d+))?)?( (?P<ap>AM|PM))?"
    tail = r" ?(?P<z>[+-]\d\d(:?\d\d)?|[A-Za-z_]+(/[A-Za-z_]+)*)?"
    forms = [
        r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)[T ]" + clock + tail,
        r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)T(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)" + tail,
        r"\w{3}, (?P<d>\d\d) (?P<m>\w{3}) (?P<y>\d{4}) " + clock + tail,
        r"(?P<m>\w{3}) (?P<d>\d{1,2}), (?P<y>\d{4}) " + clock + tail,
        r"(?P<d>\d\d)\.(?P<m>\d\d)\.(?P<y>\d{4}) " + clock + tail,
        (r"(?P<m>\d\d)/(?P<d>\d\d)" if day_order == "mdy" else r"(?P<d>\d\d)/(?P<m>\d\d)") + r"/(?P<y>\d{4}) " + clock + tail,
    ]
    for form in forms:
        if not (x := re.fullmatch(form, raw)):
            continue
        g = x.groupdict()
        hour = int(g["h"])
        if g.get("ap"):
            hour = hour % 12 + 12 * (g["ap"] == "PM")
        try:
            month = int(g["m"]) if g["m"].isdigit() else MONTH[g["m"]]
            local = datetime(int(g["y"]), month, int(g["d"]), hour, int(g["mi"]), int(g["s"] or 0))
        except (ValueError, KeyError):
            return None
        fraction = int(((g.get("f") or "") + "000000")[:6])
        z = g.get("z")
        if z and z[0] in "+-":
            digits = z[1:].replace(":", "").ljust(4, "0")
            shift = (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if z[0] == "-" else 1)
            utc = local.replace(tzinfo=timezone.utc) - timedelta(minutes=shift)
        elif z in ZONES:
            utc = local.replace(tzinfo=timezone.utc) - timedelta(hours=ZONES[z])
        else:
            utc = local.replace(tzinfo=ZoneInfo(z or zone), fold=0).astimezone(timezone.utc)
        return round(utc.timestamp()) * 10**6 + fraction
    return None


def drift(rows: list[tuple[int, int, str]]) -> set[tuple]:
    """Changes of (feed, file, payload) rows, by comparing whole files in memory."""
    kinds = {str: "string", bool: "boolean", int: "number", float: "number", dict: "object", list: "array"}
    files: dict = {}
    for feed, file, payload in rows:
        here = files.setdefault((feed, file), ({}, {}))
        try:
            record = json.loads(payload)
        except (TypeError, ValueError):
            continue

        def visit(value, path):
            """Value of each path in one record, lists behind arrays."""
            out = {}
            if isinstance(value, dict):
                for k, v in value.items():
                    p = f"{path}.{k}"
                    here[0].setdefault(p, set())
                    if v is not None:
                        here[0][p].add(kinds[type(v)])
                    out[p] = v
                    out.update(visit(v, p))
            elif isinstance(value, list):
                parts = [visit(v, f"{path}[]") for v in value]
                for p in {p for x in parts for p in x}:
                    found = [x.get(p) for x in parts]
                    out[p] = found if any(f is not None for f in found) else None
            return out

        if not isinstance(record, dict):
            continue
        values = visit(record.get("attributes"), "attributes")
        here[1].setdefault(json.dumps(record.get("id")), []).append(values)
    out = set()
    for feed in {k[0] for k in files}:
        numbers = sorted(k[1] for k in files if k[0] == feed)
        for before, now in zip(numbers, numbers[1:]):
            (old, old_rows), (new, new_rows) = files[feed, before], files[feed, now]
            gone, come, done = set(old) - set(new), set(new) - set(old), set()
            for o in gone:
                for n in come:
                    if o.rpartition(".")[0] == n.rpartition(".")[0]:
                        pairs = [(a.get(o), b.get(n)) for i in old_rows if i in new_rows for a in old_rows[i] for b in new_rows[i]]
                        pairs = [p for p in pairs if p[0] is not None and p[1] is not None]
                        if pairs and all(a == b for a, b in pairs):
                            out.add((feed, now, "renamed", n, o))
                            done |= {o, n}
            out |= {(feed, now, "removed", o, "") for o in gone - done} | {(feed, now, "added", n, "") for n in come - done}
            out |= {(feed, now, "type_changed", p, "") for p in set(old) & set(new) if old[p] and new[p] and old[p] != new[p]}
    return out
