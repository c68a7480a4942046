"""The text of RTF files."""

from __future__ import annotations

import codecs
import re

_TOKEN = re.compile(r"\\([A-Za-z]+)(-?[0-9]+)? ?|\\'([0-9A-Fa-f]{2})|\\([\s\S])|([{}])|[\r\n]+|([^\\{}\r\n]+)")

# Fixed values of the format: groups that hold no text, and control words that stand for a character.
NO_TEXT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "listtable", "listoverridetable", "rsidtbl", "generator", "themedata", "datastore", "fldinst"}
SYMBOLS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "~": " ", "_": "-", "\n": "\n", "\r": "\n", "\\": "\\", "{": "{", "}": "}"}


def _codec(number: str) -> str:
    try:
        return codecs.lookup(f"cp{number}").name
    except LookupError:
        return "cp1252"


def rtf_text(content: bytes) -> str:
    """The lines of an RTF file that aren't blank, trimmed; ``ValueError`` if it isn't one.

    Bytes are in the file's code page. After a character by number, the ones that stand in for it are
    skipped; numbers are UTF-16, so two can be one character. A group left open ends with the file.
    """
    source = content.decode("latin-1")
    if not source.lstrip().startswith("{\\rtf"):
        raise ValueError("not RTF")
    out, raw, units, codec = [], bytearray(), bytearray(), "cp1252"
    skip, stand_in, pending = False, 1, 0
    outer: list[tuple[bool, int]] = []

    def flush() -> None:
        if raw:
            out.append(raw.decode(codec, "replace"))
            raw.clear()
        if units:
            out.append(units.decode("utf-16-le", "replace"))
            units.clear()

    at = 0
    while token := _TOKEN.match(source, at):
        at = token.end()
        word, number, byte, symbol, brace, plain = token.groups()
        if brace:
            pending = 0
            if brace == "{":
                outer.append((skip, stand_in))
            elif outer:
                skip, stand_in = outer.pop()
        elif word == "bin":
            at += max(0, int(number or 0))
        elif word in NO_TEXT or symbol == "*":
            skip = True
        elif word == "uc":
            stand_in = int(number or 1)
        elif word == "ansicpg":
            flush()
            codec = _codec(number or "1252")
        elif skip:
            continue
        elif word == "u" and number:
            if raw:
                flush()
            units += (int(number) & 0xFFFF).to_bytes(2, "little")
            pending = stand_in
        elif pending and (byte or word in SYMBOLS or symbol):
            pending -= 1
        elif byte:
            if units:
                flush()
            raw.append(int(byte, 16))
        elif plain:
            kept = plain[pending:]
            pending = max(0, pending - len(plain))
            if kept:
                if units:
                    flush()
                raw += kept.encode("latin-1")
        elif (word or symbol) in SYMBOLS:
            flush()
            out.append(SYMBOLS[word or symbol])
    flush()
    return "\n".join(line.strip() for line in "".join(out).split("\n") if line.strip())
