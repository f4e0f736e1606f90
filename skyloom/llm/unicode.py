"""Code points of text slices and per-code-point tables, built once per task."""

from __future__ import annotations

import numpy as np

TABLE = 0x40000  # the planes above hold no letters
# First and last code point of each script's main blocks.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3FFFF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]


class CodePoints:
    """Tables: is_letter, lower (lower-cased code point) and script number per code point."""

    def __init__(self):
        chars = [chr(c) for c in range(TABLE)]
        self.is_letter = np.fromiter((c.isalpha() for c in chars), dtype=bool, count=TABLE)
        self.lower = np.arange(TABLE, dtype=np.uint32)
        for c in np.flatnonzero(self.is_letter).tolist():
            low = chars[c].lower()
            if len(low) == 1:
                self.lower[c] = ord(low)
        self.script = np.zeros(TABLE, dtype=np.int8)
        for name, lo, hi in SCRIPTS:
            self.script[lo:hi + 1] = SCRIPT_NAMES.index(name)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points) of a slice of UTF-8 texts."""
    starts = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=starts[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    return points, starts[offsets]
