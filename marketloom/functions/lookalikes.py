"""Letters of other scripts that look like Latin ones, and characters that show nothing."""

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ӏ": "I",
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y",
    "х": "x", "ԁ": "d", "ԝ": "w", "ѵ": "v", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ё": "ë",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "τ": "t", "γ": "y",
    "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "Ս": "U",
}
# Latin letters that pass for another one whatever surrounds them.
ALWAYS = {"ð": "đ", "Ð": "Đ", "Ɖ": "Đ", "ı": "i", "ɡ": "g", "ɑ": "a"}
# Characters that show nothing.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF]
# Spaces that show as an ordinary one.
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
