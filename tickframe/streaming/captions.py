"""Line 21 captions: screens from byte pairs, as a machine over a stream's packets.

Pop-on text is written out of sight and shown at once, paint-on text appears where it is written, roll-up text
moves up a row at a carriage return.  A screen is given out when it is replaced: from the change that made it
to the change that ended it (an end of caption, an erasure, a carriage return).  ``live`` gives each screen as it
changes instead, without an end.
"""

from __future__ import annotations

from .machines import Machine

ROWS, COLUMNS = 15, 32
#: Rows of preamble codes, by first byte and the upper half of the second's range; control codes of the first channel.
PREAMBLE_ROWS = {0x10: (11, 11), 0x11: (1, 2), 0x12: (3, 4), 0x13: (12, 13), 0x14: (14, 15), 0x15: (5, 6), 0x16: (7, 8), 0x17: (9, 10)}
POP_ON, BACK, CLEAR_ROW, ROLL_UP, PAINT_ON, TEXT, ERASE, RETURN, ERASE_HIDDEN, SHOW = 0x20, 0x21, 0x24, (0x25, 0x26, 0x27), 0x29, (0x2A, 0x2B), 0x2C, 0x2D, 0x2E, 0x2F
#: Characters that differ from ASCII, and the special ones.
BASIC = {0x27: "’", 0x2A: "á", 0x5C: "é", 0x5E: "í", 0x5F: "ó", 0x60: "ú", 0x7B: "ç", 0x7C: "÷", 0x7D: "Ñ", 0x7E: "ñ", 0x7F: "█"}
SPECIAL = "®°½¿™¢£♪à\xa0èâêîôû"
EXTENDED = {0x12: "ÁÉÓÚÜü´¡*‘-©℠·“”ÀÂÇÈÊËëÎÏïÔÙùÛ«»", 0x13: "ÃãÍÌìÒòÕõ{}\\^_|~ÄäÖöß¥¤¦ÅåØø┌┐└┘"}


def _initial() -> dict:
    return {"mode": "roll", "rows": 2, "row": 11, "column": 0, "shown": {}, "hidden": {}, "since": None, "last": None, "given": ""}


def _text(screen: dict) -> str:
    """Rows from the top; state that went through JSON has its keys as text."""
    lines = []
    for _, cells in sorted((int(k), v) for k, v in screen.items()):
        at = {int(k): c for k, c in cells.items()}
        lines.append("".join(at.get(i, " ") for i in range(max(at, default=-1) + 1)).strip())
    return "\n".join(line for line in lines if line)


def _screen(state: dict) -> dict:
    return state["hidden" if state["mode"] == "pop" else "shown"]


def _write(state: dict, c: str) -> None:
    if state["mode"] == "text":
        return
    _screen(state).setdefault(str(state["row"]), {})[str(state["column"])] = c
    state["column"] = min(COLUMNS - 1, state["column"] + 1)


def _back(state: dict) -> None:
    state["column"] = max(0, state["column"] - 1)
    _screen(state).get(str(state["row"]), {}).pop(str(state["column"]), None)


def _roll(state: dict) -> None:
    base, kept = state["row"], {}
    for row, cells in state["shown"].items():
        if base - state["rows"] + 1 < int(row) <= base:
            kept[str(int(row) - 1)] = cells
    state["shown"], state["column"] = kept, 0


def _control(state: dict, code: int) -> bool:
    """Acts on a control code; whether it ends the screen that is shown."""
    if code == POP_ON:
        state["mode"] = "pop"
    elif code == PAINT_ON:
        state["mode"] = "paint"
    elif code in TEXT:
        state["mode"] = "text"
    elif code in ROLL_UP:
        rows = ROLL_UP.index(code) + 2
        if state["mode"] != "roll":
            state["row"], state["column"] = ROWS, 0
        state["mode"], state["rows"] = "roll", rows
    elif code == BACK:
        _back(state)
    elif code == CLEAR_ROW:
        cells = _screen(state).get(str(state["row"]), {})
        for at in [k for k in cells if int(k) >= state["column"]]:
            del cells[at]
    elif code == ERASE_HIDDEN:
        state["hidden"] = {}
    elif code == ERASE or code == SHOW or (code == RETURN and state["mode"] == "roll"):
        return True
    return False


def _pairs(state: dict, at: int, data: str, live: bool):
    for i in range(0, len(data) - 3, 4):
        one, two = (int(data[k : k + 2], 16) & 0x7F for k in (i, i + 2))
        pair = one << 8 | two
        if 0x10 <= one <= 0x1F:
            repeated, state["last"] = pair == state["last"], pair
            if repeated:
                state["last"] = None  # control codes are sent twice
                continue
            one &= 0x17  # the second channel's codes differ in one bit
            if two >= 0x40:
                state["row"] = PREAMBLE_ROWS[one][two >> 5 & 1]
                state["column"] = (two & 0x0E) * 2 if two & 0x10 else 0
            elif one in (0x14, 0x15) and two >= 0x20:
                if _control(state, two):
                    if state["since"] is not None and (text := _text(state["shown"])) and not live:
                        yield state["since"], at, text
                    state["since"] = at
                    if two == SHOW:
                        state["shown"], state["hidden"], state["mode"] = state["hidden"], state["shown"], "pop"
                    elif two == ERASE:
                        state["shown"] = {}
                    else:
                        _roll(state)
            elif one == 0x17 and 0x21 <= two <= 0x23:
                state["column"] = min(COLUMNS - 1, state["column"] + two - 0x20)
            elif one == 0x11 and 0x30 <= two <= 0x3F:
                _write(state, SPECIAL[two - 0x30])
            elif one in EXTENDED and 0x20 <= two <= 0x3F:
                _back(state)  # stands for the plain character sent before
                _write(state, EXTENDED[one][two - 0x20])
            elif one == 0x11 and 0x20 <= two <= 0x2F:
                _write(state, " ")
        else:
            state["last"] = None
            for b in (one, two):
                if b >= 0x20:
                    if state["since"] is None:
                        state["since"] = at
                    _write(state, BASIC.get(b, chr(b)))
        if live and (text := _text(state["shown"])) != state["given"]:
            state["given"] = text
            yield at, None, text


def _step(live: bool):
    return lambda state, row: _pairs(state, row["at"], row["data"] or "", live)


def _finish(state: dict):
    if state["since"] is not None and (text := _text(state["shown"])):
        yield state["since"], None, text


#: Rows: ``at`` (time) and ``data`` (byte pairs as hexadecimal).
buffered = Machine(_initial, _step(False), _finish, "start_us long, end_us long, text string")
live = Machine(_initial, _step(True), lambda state: (), "start_us long, end_us long, text string")
