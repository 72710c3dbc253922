"""Images by a pluggable recogniser, and the reading order of recognised lines."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from quire.kernels.model import BLANK_LINES, EMPTY_DOCUMENT, ConvertError, Info, NotAccepted, Result, Section

#: Lines whose lower edges fall into one row of this height (a share of the page) are read
#: from left to right; larger sides than MOST_PIXELS are to be scaled down by an engine.
ROW_HEIGHT = 0.012
MOST_PIXELS = 4000


@dataclass(frozen=True)
class Box:
    """A recognised line, with its lower left corner as shares of the page."""

    text: str
    x: float
    y: float


def reading_order(boxes: list[Box]) -> list[str]:
    rows = sorted(boxes, key=lambda b: (-math.floor(b.y / ROW_HEIGHT), b.x))
    return [t for b in rows if (t := b.text.strip(BLANK_LINES))]


#: Takes a file's bytes and gives each frame's lines.
Engine = Callable[[bytes], list[list[Box]]]


def convert_image(data: bytes, info: Info, engine: Engine | None = None) -> Result:
    """One section for an image of one frame, else one for each frame with text."""
    if not info.ocr or engine is None:
        raise NotAccepted
    frames = ["\n".join(reading_order(f)) for f in engine(data)]
    if not any(frames):
        raise ConvertError(EMPTY_DOCUMENT)
    how = {"extractionMethod": "ocr"}
    if len(frames) == 1:
        sections = [Section("body", frames[0], title=info.filename, metadata=how)]
    else:
        sections = [Section("body", t, page_start=k, page_end=k, metadata=how) for k, t in enumerate(frames, 1) if t]
    return Result(sections, title=info.filename)
