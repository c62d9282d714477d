"""The object syntax: a tokenizer for objects and content streams, and values as tagged JSON.

Names are {"t": "name", "v": text}, strings {"t": "str", "hex": bytes, "text": text}, references {"t": "ref", "n": number,
"g": generation}; numbers, booleans, null, arrays and dictionaries are JSON's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Levels of nested arrays and dictionaries, beyond which a value is malformed.
MAX_DEPTH = 200
_TOKEN = re.compile(
    rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*(?:(<<|>>|[\[\]{}])|/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|<([0-9A-Fa-f\x00\t\n\x0c\r ]*)>|(\()|([^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(.))?", re.DOTALL
)
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
#: The rest of an array of plain integers.
_INTEGERS = re.compile(rb"(?:[\t\n\x0c\r ]*+\d++(?=[\t\n\x0c\r \]]))*+[\t\n\x0c\r ]*+\]")
_IN_STRING = re.compile(rb"[()\\]")
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\r\n])|(.))|\r\n?", re.DOTALL)
_IMAGE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)")
#: What the letter after a backslash stands for; other characters stand for themselves.
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Characters of the document encoding that differ from Latin-1, from 0x18 and from 0x80 on.
PDFDOC_LOW = "\u02d8\u02c7\u02c6\u02d9\u02dd\u02db\u02da\u02dc"
PDFDOC_HIGH = "\u2022\u2020\u2021\u2026\u2014\u2013\u0192\u2044\u2039\u203a\u2212\u2030\u201e\u201c\u201d\u2018\u2019\u201a\u2122\ufb01\ufb02\u0141\u0152\u0160\u0178\u017d\u0131\u0142\u0153\u0161\u017e"
#: Bytes of the document encoding that stand for other characters than in Latin-1, and these; 0x7f, 0x9f and 0xad stand for none.
PDFDOC_FROM = "".join(map(chr, [*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0]))
PDFDOC_TO = PDFDOC_LOW + PDFDOC_HIGH + "\u20ac"
_PDFDOC = str.maketrans(PDFDOC_FROM, PDFDOC_TO)


class SyntaxFault(ValueError):
    pass


def text_of(data: bytes) -> str:
    """A string's text: UTF-16BE after its byte order mark, else the document encoding."""
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    return data.decode("latin-1").translate(_PDFDOC)


def name_text(token: bytes) -> str:
    token = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), token)
    try:
        return token.decode("utf-8")
    except UnicodeDecodeError:
        return token.decode("latin-1")


def unescape(raw: bytes) -> bytes:
    """A literal string's bytes: escapes resolved, line ends as newlines."""

    def one(m: re.Match) -> bytes:
        if m[1]:
            return bytes([int(m[1], 8) & 255])
        if m[2]:
            return b""
        return b"\n" if m[3] is None else _LETTERS.get(m[3], m[3])

    return _ESCAPE.sub(one, raw) if b"\\" in raw or b"\r" in raw else raw


def escape(data: bytes) -> bytes:
    """A literal string's inside for data."""
    return re.sub(rb"[\\()\r\n]", lambda m: {b"\r": b"\\r", b"\n": b"\\n"}.get(m[0], b"\\" + m[0]), data)


def _string_end(data: bytes, at: int) -> int:
    """The place of the parenthesis that closes the string whose inside starts at `at`."""
    depth = 1
    while m := _IN_STRING.search(data, at):
        at = m.end()
        if m[0] == b"\\":
            at += 1
        elif m[0] == b"(":
            depth += 1
        else:
            depth -= 1
            if not depth:
                return m.start()
    raise SyntaxFault("a string has no end")


def literal(token: bytes) -> bool | int | float | None:
    """true, false, null, an integer or a real; anything else raises."""
    if token.isdigit():
        return int(token)
    if token in (b"true", b"false"):
        return token == b"true"
    if token == b"null":
        return None
    if _NUMBER.match(token):
        return float(token) if b"." in token else int(token)
    raise SyntaxFault(f"not a literal: {token[:40]!r}")


def string_value(data: bytes) -> dict:
    return {"t": "str", "hex": data.hex(), "text": text_of(data)}


def statements(data: bytes, at: int = 0, images: bool = False) -> Iterator[tuple[list, str | None, int]]:
    """(operands, keyword, place after it) of each keyword outside arrays and dictionaries; at last what no keyword follows.

    Content streams are such statements, and so are objects (`1 0 obj`, then `value endobj`). With images, an inline
    image is one statement EI, with its dictionary and its data.
    """
    stack: list[list] = [[]]
    kinds: list[bytes] = []
    while True:
        m = _TOKEN.match(data, at)
        at = m.end()
        now = stack[-1]
        if m.lastindex is None:
            if stack[0]:
                yield stack[0], None, at
            return
        mark, name, hexa, string, word, other = m.groups()
        if mark in (b"<<", b"[", b"{"):
            if len(stack) > MAX_DEPTH:
                raise SyntaxFault("nested too deeply")
            if mark == b"[" and (m := _INTEGERS.match(data, at)):  # such as a font's widths
                now.append([int(x) for x in data[at : m.end() - 1].split()])
                at = m.end()
                continue
            kinds.append(mark)
            stack.append([])
        elif mark:
            if not kinds or kinds[-1] != {b">>": b"<<", b"]": b"[", b"}": b"{"}[mark]:
                raise SyntaxFault(f"{mark.decode()} closes nothing")
            kinds.pop()
            inside = stack.pop()
            if mark == b">>":
                inside = {k["v"]: v for k, v in zip(inside[::2], inside[1::2], strict=False) if isinstance(k, dict) and k.get("t") == "name"}
            stack[-1].append(None if mark == b"}" else inside)  # a procedure has no value
        elif name is not None:
            now.append({"t": "name", "v": name_text(name)})
        elif hexa is not None:
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", hexa).decode()
            now.append(string_value(bytes.fromhex(digits + "0" * (len(digits) % 2))))
        elif string:
            end = _string_end(data, at)
            now.append(string_value(unescape(data[at:end])))
            at = end + 1
        elif other is not None:
            raise SyntaxFault(f"unexpected {other!r}")
        elif word == b"R" and len(now) > 1 and all(type(x) is int and x >= 0 for x in now[-2:]):
            number = now[-2:]
            del now[-2:]
            now.append({"t": "ref", "n": number[0], "g": number[1]})
        else:
            try:
                now.append(literal(word))
            except SyntaxFault:
                if len(stack) > 1:  # a keyword inside a value has no meaning
                    continue
                key = word.decode("latin-1")
                if images and key == "ID":
                    found = _IMAGE_END.search(data, at)
                    end = found.start() if found else len(data)
                    pairs = {k["v"]: v for k, v in zip(now[::2], now[1::2], strict=False) if isinstance(k, dict)}
                    yield [pairs, string_value(data[at + 1 : end])], "EI", end
                    stack[0], at = [], found.end() if found else len(data)
                elif images and key == "BI":
                    stack[0] = []
                else:
                    yield now, key, at
                    stack[0] = []


def value_at(data: bytes, at: int = 0) -> object:
    """The first value from a place on."""
    for operands, _, _ in statements(data, at):
        if operands:
            return operands[0]
    raise SyntaxFault("no value")


def encode_value(value: object) -> bytes:
    """A tagged value in object syntax."""
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return str(value).encode()
    if isinstance(value, float):
        return format(value, ".6f").rstrip("0").rstrip(".").encode()
    if isinstance(value, str):
        return b"/" + re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02X" % m[0][0], value.encode())
    if isinstance(value, bytes):
        return b"(" + escape(value) + b")"
    if isinstance(value, list):
        return b"[" + b" ".join(map(encode_value, value)) + b"]"
    tag = value.get("t")
    if tag == "name":
        return encode_value(value["v"])
    if tag == "ref":
        return b"%d %d R" % (value["n"], value["g"])
    if tag == "str":
        return b"<" + value["hex"].encode() + b">"
    return b"<<" + b" ".join(encode_value(k) + b" " + encode_value(v) for k, v in value.items()) + b">>"
