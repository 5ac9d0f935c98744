"""WebVTT beyond plain text: where cues are placed, and how style blocks dress their text.

After the W3C specification (regions, cue settings, the ``::cue`` cascade).  Whatever can't be read is skipped and the
defaults stay, so any file gives rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from .cues import _VTT, _us, decode

#: Fixed values of the specification.
INHERITED = ("color", "bold", "italic", "underline", "family", "size")
COLORS = {
    "black": "000000", "silver": "c0c0c0", "gray": "808080", "white": "ffffff", "maroon": "800000", "red": "ff0000", "purple": "800080", "fuchsia": "ff00ff", "green": "008000", "lime": "00ff00",
    "olive": "808000", "yellow": "ffff00", "navy": "000080", "blue": "0000ff", "teal": "008080", "aqua": "00ffff", "cyan": "00ffff", "magenta": "ff00ff", "orange": "ffa500",
}
SIZES = {"xx-small": 0.6, "x-small": 0.75, "small": 8 / 9, "medium": 1.0, "large": 1.2, "x-large": 1.5, "xx-large": 2.0}
SETTINGS = "path string, seq int, vertical string, line double, snap boolean, line_align string, position double, position_align string, size double, align string, region string"
RUNS = "path string, seq int, run int, text string, voice string, color string, background string, bold boolean, italic boolean, underline boolean, family string, size double, opacity double"


@dataclass
class File:
    sheets: list[str] = field(default_factory=list)
    regions: dict[str, dict] = field(default_factory=dict)
    cues: list[tuple[str, int, int, str, str]] = field(default_factory=list)  # id, start, end, settings, text


def read(text: str) -> File:
    out = File()
    blocks = re.split(r"\n{2,}", text.lstrip("﻿"))
    if not re.match(r"WEBVTT(?:[ \t\n]|$)", blocks[0]):
        return out
    for block in blocks[1:]:
        lines = block.strip("\n").split("\n")
        timed = next((i for i, line in enumerate(lines[:2]) if _VTT.match(line)), None)
        if timed is not None:
            m = _VTT.match(lines[timed])
            g = m.groups()
            out.cues.append((lines[0] if timed else "", _us(*g[:4]), _us(*g[4:]), lines[timed][m.end() :], "\n".join(lines[timed + 1 :])))
        elif out.cues:
            continue  # style and region blocks stand before the first cue
        elif lines[0].strip() == "STYLE":
            out.sheets.append("\n".join(lines[1:]))
        elif lines[0].strip() == "REGION":
            found = dict(x.split(":", 1) for line in lines[1:] for x in line.split() if ":" in x)
            if found.get("id"):
                out.regions[found["id"]] = found
    return out


# --- settings -----------------------------------------------------------------------------------------------------


def _percent(text: str) -> float | None:
    value = float(text[:-1]) if re.fullmatch(r"\d+(?:\.\d+)?%", text, re.A) else None
    return value if value is not None and value <= 100 else None


def settings(text: str, regions: dict[str, dict] | None = None) -> tuple:
    """(vertical, line, snap to lines, line alignment, position, its alignment, size, text alignment, region); null is automatic.

    Settings apply in order; one that isn't valid is skipped.  A cue with a line, a writing direction or a size of its own leaves
    its region."""
    vertical, line, snap, line_align, position, position_align, size, align, region = "", None, True, "start", None, "auto", 100.0, "center", None
    for word in re.split(r"[ \t\n\f\r]+", text):
        name, _, value = word.partition(":")
        if not name or not value:
            continue
        first, comma, second = value.partition(",")
        if name == "region":
            region = value if value in (regions or {}) else None
        elif name == "vertical" and value in ("rl", "lr"):
            vertical, region = value, None
        elif name == "line":
            percent = _percent(first)
            number = float(first) if percent is None and re.fullmatch(r"-?\d+(?:\.\d+)?", first, re.A) else None
            if (percent is None and number is None) or (comma and second not in ("start", "center", "end")):
                continue
            line, snap, line_align, region = percent if number is None else number, number is not None, second or line_align, None
        elif name == "position" and (percent := _percent(first)) is not None and (not comma or second in ("line-left", "center", "line-right")):
            position, position_align = percent, second or position_align
        elif name == "size" and (percent := _percent(value)) is not None:
            size, region = percent, region if percent == 100 else None
        elif name == "align" and value in ("start", "center", "end", "left", "right"):
            align = value
    return vertical, line, snap, line_align, position, position_align, size, align, region


def placed(position: float | None, position_align: str, align: str, rtl: bool = False) -> tuple[float, str]:
    """The position and its alignment in use, where they follow from the text's."""
    side = {"start": "right" if rtl else "left", "end": "left" if rtl else "right"}.get(align, align)
    at = position if position is not None else {"left": 0.0, "right": 100.0}.get(side, 50.0)
    return at, position_align if position_align != "auto" else {"left": "line-left", "right": "line-right"}.get(side, "center")


# --- style blocks -------------------------------------------------------------------------------------------------


def color(text: str) -> str | None:
    """Eight hexadecimal digits, red to alpha."""
    text = text.strip().lower()
    if text == "transparent":
        return "00000000"
    if text in COLORS:
        return COLORS[text] + "ff"
    if m := re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", text):
        digits = m[1] if len(m[1]) > 4 else "".join(c * 2 for c in m[1])
        return digits if len(digits) == 8 else digits + "ff"
    if m := re.fullmatch(r"rgba?\(([^)]*)\)", text):
        parts = re.split(r"[\s,/]+", m[1].strip())
        if len(parts) not in (3, 4) or not all(re.fullmatch(r"\d+(?:\.\d+)?%?|\.\d+", p) for p in parts):
            return None
        number = lambda p, whole: float(p[:-1]) / 100 * whole if p[-1] == "%" else float(p)
        values = [number(p, 255) for p in parts[:3]] + [255 * number(p, 1) for p in parts[3:] or ["1"]]
        return "".join(f"{int(min(255, max(0, v)) + 0.5):02x}" for v in values)
    return None


@dataclass
class Rule:
    selector: list[tuple] | None  # compounds from the outermost; None is the cue itself
    weight: tuple[int, int, int]
    declarations: dict[str, str]


_COMPOUND = re.compile(r"""([A-Za-z]+)|\.([\w-]+)|\#([\w-]+)|\[(\w+)=["']?([^"'\]]*)["']?\]""")


def _compound(text: str) -> tuple | None:
    """(name, classes, id, attributes), or None where something else stands in it."""
    name, classes, own, attributes, at = "", set(), "", {}, 0
    while at < len(text):
        m = _COMPOUND.match(text, at)
        if not m or (m[1] and at):
            return None
        if m[1]:
            name = m[1].lower()
        elif m[2]:
            classes.add(m[2])
        elif m[3]:
            own = m[3]
        else:
            attributes[m[4].lower()] = m[5]
        at = m.end()
    return name, frozenset(classes), own, attributes


def rules(sheets: list[str]) -> list[Rule]:
    """Rules for cues in order.  A rule with a selector that isn't understood, such as a pseudo-class, is skipped whole."""
    out = []
    for sheet in sheets:
        for head, body in re.findall(r"([^{}]*)\{([^{}]*)\}", re.sub(r"/\*.*?\*/", " ", sheet, flags=re.S)):
            m = re.fullmatch(r"::cue(?:\((.*)\))?", head.strip(), re.S)
            if not m:
                continue
            pairs = (x.partition(":") for x in body.split(";"))
            declarations = {k.strip().lower(): v.strip() for k, colon, v in pairs if colon}
            if m[1] is None:
                out.append(Rule(None, (0, 0, 0), declarations))
                continue
            chains = [[_compound(c) for c in part.split()] for part in m[1].split(",")]
            if all(chain and None not in chain for chain in chains):
                for chain in chains:
                    weight = (sum(bool(c[2]) for c in chain), sum(len(c[1]) + len(c[3]) for c in chain), sum(bool(c[0]) for c in chain))
                    out.append(Rule(chain, weight, declarations))
    return out


@dataclass(frozen=True)
class Style:
    color: str = "ffffffff"
    background: str | None = None
    bold: bool = False
    italic: bool = False
    underline: bool = False
    family: str | None = None
    size: float = 1.0
    opacity: float = 1.0


def _dressed(style: Style, parent: Style, declarations: dict[str, str]) -> Style:
    new = {}
    for name, value in declarations.items():
        low = value.lower()
        if name == "color" and (found := color(value)):
            new["color"] = found
        elif name in ("background-color", "background") and (found := color(value)):
            new["background"] = found
        elif name == "font-weight":
            new["bold"] = low in ("bold", "bolder") or (low.isdecimal() and int(low) >= 600)
        elif name == "font-style":
            new["italic"] = low in ("italic", "oblique")
        elif name in ("text-decoration", "text-decoration-line"):
            new["underline"] = "underline" in low.split()
        elif name == "font-family":
            new["family"] = value.split(",")[0].strip().strip("\"'")
        elif name == "font-size":
            if m := re.fullmatch(r"(\d*\.?\d+)(%|em)", low):
                new["size"] = parent.size * float(m[1]) / (100 if m[2] == "%" else 1)
            elif low in ("smaller", "larger"):
                new["size"] = parent.size * (5 / 6 if low == "smaller" else 1.2)
            elif low in SIZES:
                new["size"] = SIZES[low]
        elif name == "opacity" and (m := re.fullmatch(r"(\d*\.?\d+)(%?)", low)):
            new["opacity"] = min(1.0, float(m[1]) / (100 if m[2] else 1))
    return replace(style, **new)


def _fits(compound: tuple, node: tuple, cue_id: str) -> bool:
    name, classes, own, attributes = compound
    kind, own_classes, annotation = node
    if own and (kind or own != cue_id):
        return False
    if name and name != kind:
        return False
    held = {"v": "voice", "lang": "lang"}.get(kind)
    return classes <= own_classes and all(k == held and v == annotation for k, v in attributes.items())


def _matches(chain: list[tuple], path: list[tuple], cue_id: str) -> bool:
    """Whether the last compound fits the last node and the others fit enclosing ones, in order."""
    if not _fits(chain[-1], path[-1], cue_id):
        return False
    i = len(chain) - 2
    for node in reversed(path[:-1]):
        if i >= 0 and _fits(chain[i], node, cue_id):
            i -= 1
    return i < 0


_TAG = re.compile(r"<(/?)([A-Za-z]*)((?:\.[^\s.<>/]+)*)[ \t\n]?([^<>]*)>")
#: The elements of cue text; others and time tags are left out.
NODES, DEFAULTS = frozenset("c i b u v ruby rt lang".split()), {"i": {"font-style": "italic"}, "b": {"font-weight": "bold"}, "u": {"text-decoration": "underline"}}


def styled(text: str, cue_id: str, sheet: list[Rule]) -> Iterator[tuple[str, str | None, Style]]:
    """(text, voice, style) of each run of a cue's text.  More specific rules win, of equal ones the later; colour, weight and size flow to
    inner nodes, background and opacity stay on the node they are given to."""
    path: list[tuple] = [("", frozenset(), "")]

    def style_of() -> Style:
        styles = [Style()]
        for depth in range(1, len(path) + 1):
            node, parent = path[depth - 1], styles[-1]
            own = Style(**{k: getattr(parent, k) for k in INHERITED})
            found = [(r.weight, i, r.declarations) for i, r in enumerate(sheet) if (depth == 1 if r.selector is None else _matches(r.selector, path[:depth], cue_id))]
            merged = dict(DEFAULTS.get(node[0], {}))
            for _, _, declarations in sorted(found, key=lambda x: x[:2]):
                merged.update(declarations)
            styles.append(_dressed(own, parent, merged))
        # what lies behind a run: the innermost background, all opacities
        background = next((s.background for s in reversed(styles) if s.background), None)
        opacity = 1.0
        for s in styles:
            opacity *= s.opacity
        return replace(styles[-1], background=background, opacity=opacity)

    at = 0
    for m in [*_TAG.finditer(text), None]:
        shown = html.unescape(re.sub(r"<[^>]*>", "", text[at : m.start() if m else len(text)]))
        if shown:
            yield shown, next((n[2] for n in reversed(path) if n[0] == "v"), None), style_of()
        if not m:
            return
        at = m.end()
        closing, name = m[1], m[2].lower()
        if name not in NODES:
            continue
        if not closing:
            path.append((name, frozenset(c for c in m[3].split(".") if c), html.unescape(m[4].strip())))
        elif any(n[0] == name for n in path):
            while path.pop()[0] != name:
                pass


def _table(files: DataFrame, schema: str, rows_of) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    from ..operators.stateful import CHUNK
    from ..session import ship

    ship(files.sparkSession)
    fields = StructType.fromDDL(schema).fields
    types, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(path, *row) for row in rows_of(read(decode(content or b"")))]
                for start in range(0, len(rows), CHUNK):
                    part = list(zip(*rows[start : start + CHUNK]))
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(part, types)], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def read_settings(files: DataFrame) -> DataFrame:
    """Where each cue of the files (path, content) is placed."""
    return _table(files, SETTINGS, lambda file: [(i, *settings(cue[3], file.regions)) for i, cue in enumerate(file.cues)])


def read_runs(files: DataFrame) -> DataFrame:
    """The runs of text of each cue with the styles in use."""

    def rows(file: File):
        sheet = rules(file.sheets)
        for i, (cue_id, _, _, _, text) in enumerate(file.cues):
            for k, (shown, voice, s) in enumerate(styled(text, cue_id, sheet)):
                yield i, k, shown, voice, s.color, s.background, s.bold, s.italic, s.underline, s.family, s.size, s.opacity

    return _table(files, RUNS, rows)
