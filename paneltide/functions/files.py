"""File types from content."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paneltide.functions.binding import let

# Leading bytes of known formats.
SIGNATURES = [
    ("png", "89504E470D0A1A0A"),
    ("jpg", "FFD8FF"),
    ("gif", "474946383961"),
    ("gif", "474946383761"),
    ("pdf", "25504446"),
    ("xls", "D0CF11E0A1B11AE1"),
]
BITMAP = "424D"
ZIP = "504B0304"
ZIP_CONTENT_TYPES = "[Content_Types].xml"
ZIP_FOLDERS = [("xlsx", "xl/"), ("docx", "word/"), ("pptx", "ppt/")]

# Image modes by a PNG's colour type, by a JPEG's components, by a bitmap's bits.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
BITMAP_MODES = {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGB"}
#: Segments of a JPEG looked at before its frame header; beyond, the size stays NULL.
JPEG_SEGMENTS = 1024


def _bytes(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def _holds(content: Column, text: str) -> Column:
    return F.contains(content, F.lit(text).cast("binary"))


def guess_file_type(content: Column) -> Column:
    """Type of a binary column by signature, else by what its text looks like.

    A zip without a content-type list is judged like any other content.
    """
    out = None
    for name, signature in SIGNATURES:
        hit = F.startswith(content, _bytes(signature))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    office = F.lit("zip")
    for name, folder in reversed(ZIP_FOLDERS):
        office = F.when(_holds(content, folder), F.lit(name)).otherwise(office)
    out = out.when(F.startswith(content, _bytes(ZIP)) & _holds(content, ZIP_CONTENT_TYPES), office)
    text = content.cast("string")
    return (
        out.when(~F.is_valid_utf8(text), F.lit("bin"))
        .when(text.rlike(r"(?U)^[\s\x1c-\x1f]*[\[{]"), F.lit("json"))
        .when(F.contains(text, F.lit(",")), F.lit("csv"))
        .when(F.contains(text, F.lit("\t")), F.lit("tsv"))
        .otherwise(F.lit("txt"))
    )


def extension(path: Column) -> Column:
    """Lower-case text after the last period of a file name."""
    return F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", -1))


def _number(content: Column, at: Column | int, width: int, little: bool = False) -> Column:
    """Unsigned number in ``width`` bytes from offset ``at``."""
    offsets = reversed(range(width)) if little else range(width)
    start = F.lit(at) if isinstance(at, int) else at
    parts = [F.hex(F.substring(content, (start + i + 1).cast("int"), F.lit(1))) for i in offsets]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def _named(number: Column, names: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), number.cast("int"))


def _image(kind: str, mode: Column, width: Column, height: Column) -> Column:
    return F.struct(F.lit(kind).alias("format"), mode.alias("mode"), width.alias("width"), height.alias("height"))


def _frame(content: Column) -> Column:
    """Offset of a JPEG's frame header: segments are skipped by the lengths they state."""

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        code = _number(content, at + 1, 1)
        frame = code.between(0xC0, 0xCF) & ~code.isin(0xC4, 0xC8, 0xCC)
        further = F.when(code == 0xFF, at + 1).otherwise(at + 2 + _number(content, at + 2, 2))
        moved = F.struct(
            F.when(frame | code.isNull(), at).otherwise(F.coalesce(further, at)).alias("at"),
            F.coalesce(frame, F.lit(False)).alias("found"),
        )
        return F.when(state["found"], state).otherwise(moved)

    start = F.struct(F.lit(2).cast("long").alias("at"), F.lit(False).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(JPEG_SEGMENTS)), start, step, lambda s: F.when(s["found"], s["at"]))


def image_header(content: Column) -> Column:
    """``format, mode, width, height`` of a PNG, GIF, BMP or JPEG from its header; NULL for others.

    No pixel is decoded.  A header that ends early leaves its sizes NULL.
    """
    colour, depth = _number(content, 25, 1), _number(content, 24, 1)
    png_mode = F.when((colour == 0) & (depth == 1), F.lit("1")).when((colour == 0) & (depth == 16), F.lit("I;16"))
    png = _image("PNG", png_mode.otherwise(_named(colour, PNG_MODES)), _number(content, 16, 4), _number(content, 20, 4))
    gif = _image("GIF", F.lit("P"), _number(content, 6, 2, True), _number(content, 8, 2, True))
    rows = _number(content, 22, 4, True)
    # A bitmap stored from the top down has a negative height.
    height = F.when(rows > (1 << 31), (1 << 32) - rows).otherwise(rows)
    bitmap = _image("BMP", _named(_number(content, 28, 2, True), BITMAP_MODES), _number(content, 18, 4, True), height)

    def framed(at: Column) -> Column:
        return _image("JPEG", _named(_number(content, at + 9, 1), JPEG_MODES), _number(content, at + 7, 2), _number(content, at + 5, 2))

    jpeg = let(_frame(content), framed)
    made = {"png": png, "jpg": jpeg, "gif": gif}
    out = F.when(F.startswith(content, _bytes(BITMAP)), bitmap)
    for name, signature in SIGNATURES:
        if name in made:
            out = out.when(F.startswith(content, _bytes(signature)), made[name])
    return out
