"""Quantities with units in product names and specifications, in Vietnamese and English notation."""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

from marketloom.functions.lookalikes import ALWAYS, INVISIBLE, LOOKALIKES, SPACES

# Units by quantity, with their size in g, ml, mm or W; written without accents.
UNITS = {
    "mass": {
        "mg": 0.001, "g": 1.0, "gr": 1.0, "gam": 1.0, "gram": 1.0, "grams": 1.0, "lang": 100.0, "kg": 1000.0, "ky": 1000.0, "ki": 1000.0, "can": 1000.0, "kilo": 1000.0,
        "kilogam": 1000.0, "kilogram": 1000.0, "kilograms": 1000.0, "oz": 28.349523125, "ounce": 28.349523125, "ounces": 28.349523125, "lb": 453.59237, "lbs": 453.59237, "pound": 453.59237, "pounds": 453.59237,
    },
    "volume": {
        "ml": 1.0, "cc": 1.0, "cl": 10.0, "dl": 100.0, "l": 1000.0, "lit": 1000.0, "liter": 1000.0, "liters": 1000.0, "litre": 1000.0, "litres": 1000.0,
        "fl oz": 29.5735295625, "floz": 29.5735295625,
    },
    "length": {
        "mm": 1.0, "cm": 10.0, "phan": 10.0, "dm": 100.0, "m": 1000.0, "met": 1000.0, "meter": 1000.0, "meters": 1000.0, "metre": 1000.0, "in": 25.4, "inch": 25.4, "inches": 25.4,
        '"': 25.4, "''": 25.4, "ft": 304.8, "feet": 304.8, "foot": 304.8,
    },
    "power": {"w": 1.0, "watt": 1.0, "watts": 1.0, "oat": 1.0, "kw": 1000.0},
}
OF_UNIT = {u: (q, f) for q, units in UNITS.items() for u, f in units.items()}
# Units so small that three digits after a point are thousands, not a fraction.
SMALL = {"mg", "g", "gr", "gam", "gram", "grams", "ml", "cc", "mm", "w", "watt", "watts", "oat"}
# Number words before a unit.
NUMBER_WORDS = {"nua": 0.5, "mot": 1.0, "hai": 2.0, "ba": 3.0, "bon": 4.0, "nam": 5.0, "half a": 0.5, "one": 1.0, "two": 2.0}
# The beginnings of specification keys by quantity, without accents; '' for those that state none.
KEYS = {
    "cong suat": "power", "power": "power", "wattage": "power", "khoi luong": "mass", "trong luong": "mass", "can nang": "mass", "weight": "mass", "net weight": "mass",
    "dung tich": "volume", "the tich": "volume", "capacity": "volume", "volume": "volume", "chieu dai": "length", "do dai": "length", "length": "length", "man hinh": "length",
    "kich thuoc man hinh": "length", "screen": "length", "display": "length",
}
# Keys that name the unit of a bare number elsewhere in the specifications.
UNIT_KEYS = ("unit", "units", "dvt", "don vi", "don vi tinh")
STORAGE_KEYS = ("storage", "rom", "ram", "bo nho", "dung luong", "memory")
PHONE = re.compile(r"\b(?:dien\W+thoai|dtdd|smart\W?phones?|phones?|cellphones?|may\W+tinh\W+bang|tablets?)\b")
MOST_INCHES = 500  # a larger number before a quotation mark is no size of a screen
STORAGE_SIZES = {8, 16, 32, 64, 128, 256, 512, 1024, 2048}
GENERATIONS = {2, 3, 4, 5, 6}  # of mobile networks

NUMBER = r"\d++(?:[.,]\d++)*+"
WORD_UNIT = "|".join(re.escape(u).replace(r"\ ", "[^a-z0-9]{1,4}") for u in sorted(OF_UNIT, key=len, reverse=True) if u not in ('"', "''"))
NOISE = r"""\s*(?:[\[({"'*_:;,~-]\s*)?"""  # signs that formatting puts between a number and its unit
AMOUNT = re.compile(
    rf"(?<![a-z0-9.,])(?:({NUMBER})|({'|'.join(NUMBER_WORDS)})(?=[^a-z0-9]))"
    rf"(?:{NOISE}((?:{WORD_UNIT})(?![a-z]))|\s*(''|\")(?![a-z0-9]))(\d(?![\d.,]))?(?:[^a-z0-9]{{1,3}}(ruoi)\b)?"
)
VALUE = re.compile(rf"""^\s*({NUMBER}|{'|'.join(NUMBER_WORDS)})\s*({WORD_UNIT}|''|")?\s*(ruoi)?\s*$""")
STORED = re.compile(rf"(?<![a-z0-9.,])(\d+(?:[.,]\d+)?){NOISE}([gt])(b)?(?![a-z0-9])")


@lru_cache(2)
def ascii_table(lookalikes: bool = True) -> dict[int, str | None]:
    """Characters to what they look like in plain lower-case ASCII; invisible ones and marks to nothing."""
    out: dict[int, str | None] = {}
    for c in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFF00, 0xFFEF), *range(0x1D400, 0x1D800)]:
        plain = "".join(x for x in ud.normalize("NFKD", chr(c)) if not ud.combining(x)).lower()
        if plain and plain != chr(c) and plain.isascii():
            out[c] = plain
    if lookalikes:
        out |= {ord(a): ud.normalize("NFD", b)[0].lower() for a, b in (LOOKALIKES | ALWAYS).items()}
    out |= {ord("đ"): "d", ord("Đ"): "d", ord("ð"): "d", ord("Ð"): "d", ord("Ɖ"): "d"}
    out |= {c: " " for c in SPACES}
    out |= {c: None for c in [*INVISIBLE, *range(0x300, 0x370)]}
    out |= {ord(c): '"' for c in "”″“„"} | {ord(c): "'" for c in "’′‘"}
    out |= {ord("™"): " ", ord("®"): " "}
    return out


def plain_ascii(text: str, lookalikes: bool = True) -> str:
    """Lower case without accents, look-alikes (if wanted) and invisible characters resolved."""
    return text.lower() if text.isascii() else text.translate(ascii_table(lookalikes)).lower()


def number(text: str, unit: str = "") -> float:
    """A number with a decimal comma or point or with thousands; three digits after the only
    separator are thousands beside a small unit, otherwise a fraction."""
    if text in NUMBER_WORDS:
        return NUMBER_WORDS[text]
    parts = re.split(r"[.,]", text)
    if len(parts) == 1:
        return float(text)
    thousands = all(len(p) == 3 for p in parts[1:]) and parts[0] != "0" and len(parts[0]) <= 3
    if len(parts) > 2:
        if thousands:
            return float("".join(parts))
        return float("".join(parts[:-1]) + "." + parts[-1])
    if thousands and (unit in SMALL or not unit):
        return float("".join(parts))
    return float(".".join(parts))


def spelt(unit: str) -> str:
    """A unit as the tables spell it."""
    return "fl oz" if unit.startswith("fl") else unit


def amounts(text: str) -> list[tuple[str, float, bool]]:
    """``(quantity, amount in base units, written with the letter g alone)`` of a plain text, in
    order; adjacent amounts of one quantity in falling units ('2 kg 250 g') are added up."""
    out: list[tuple[str, float, bool]] = []
    end, last = -9, 0.0
    for m in AMOUNT.finditer(text):
        unit = spelt(m[3] or m[4])
        quantity, factor = OF_UNIT[unit]
        if m[4] and number(m[1] or m[2]) > MOST_INCHES:
            continue
        if m[1] and re.fullmatch(r"\d{5}", m[1]) and m[3] and not text[m.end(1) : m.start(3)].isspace() and m.end(1) != m.start(3):
            continue  # a model code before a separator
        if unit == "in" and m[1] and m[1].isdigit() and int(m[1]) <= 10 and re.match(r"\s*\d+\b(?!-)", text[m.end() :]):
            continue  # '2 in 1'
        value = number(m[1] or m[2], unit)
        if unit == "g" and value in GENERATIONS and m[0] == text.strip() == m[1] + unit:
            continue  # '5g' alone names no product that it could be the mass of
        if m[5] and factor >= 1000:
            value += int(m[5]) / 10
        elif m[5]:
            continue
        if m[6]:
            value += 0.5
        amount = value * factor
        if out and out[-1][0] == quantity and factor < last and re.fullmatch(r"[^a-z0-9|/]{0,6}", text[end : m.start()]):
            out[-1] = (quantity, out[-1][1] + amount, False)
        else:
            out.append((quantity, amount, unit == "g"))
        end, last = m.end(), factor
    return out


def storage(text: str) -> int | None:
    """Gigabytes of storage in a plain text: '256gb', '1 tb', or '128g'."""
    for m in STORED.finditer(text):
        value = float(m[1].replace(",", "."))
        if m[3] or value in STORAGE_SIZES:
            return int(value * (1024 if m[2] == "t" else 1))
    return None


def in_name(name: str, phone: bool = False) -> dict[str, float]:
    """The amounts that a plain name states, the first of each quantity; a phone's '128g' is storage and its '5g' a network."""
    out: dict[str, float] = {}
    phone = phone or bool(PHONE.search(name))
    for quantity, amount, letter in amounts(name):
        if not (letter and phone and (amount in STORAGE_SIZES or amount in GENERATIONS)):
            out.setdefault(quantity, amount)
    return out


def key_quantity(key: str) -> str:
    return next((q for k, q in KEYS.items() if key.startswith(k)), "")


def in_specs(specs: list[tuple[str, str]]) -> tuple[dict[str, float], dict[str, float]]:
    """The amounts that specifications state, and the bare numbers of quantities whose unit is missing."""
    stated: dict[str, float] = {}
    bare: dict[str, float] = {}
    plain = [(plain_ascii(k or "").strip(), plain_ascii(v or "").strip()) for k, v in specs]
    named = [v for k, v in plain if k in UNIT_KEYS]
    for key, value in plain:
        quantity = key_quantity(key)
        if not quantity or key.startswith(STORAGE_KEYS):
            continue
        m = VALUE.match(value)
        unit = spelt(m[2]) if m and m[2] else None
        if m and not unit:
            hint = re.search(r"\(([^)]*)\)", key)
            unit = next((u for u in [hint[1].strip() if hint else "", *named] if OF_UNIT.get(u, ("",))[0] == quantity), None)
        if m and unit:
            q, factor = OF_UNIT[spelt(unit)]
            stated.setdefault(q, (number(m[1], unit) + (0.5 if m[3] else 0)) * factor)
        elif m:
            bare.setdefault(quantity, number(m[1]))
        else:
            for q, amount, _ in amounts(value):
                if q == quantity:
                    stated.setdefault(q, amount)
    return stated, {q: v for q, v in bare.items() if q not in stated}
