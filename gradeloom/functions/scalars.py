"""Scalar functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom import constants as C


def strip(value: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def is_blank(value: Column) -> Column:
    return strip(value) == ""


def case_folded(value: Column) -> Column:
    """Texts that differ only in case become equal, by Unicode's full folding.

    Upper case writes out what has no single capital (``ß``, ligatures), and lower case
    then joins all forms of a letter. The dotless i, whose capital is that of the dotted
    one, is put aside meanwhile; the final sigma, which lower case picks by its place,
    becomes the plain one.
    """
    aside = F.translate(F.lower(value), "ı", "\ue000")
    return F.translate(F.lower(F.translate(F.upper(aside), "\ue000", "ı")), "ς", "σ")


def username_key(value: Column) -> Column:
    """Gradebook username without the export's leading ``#``, case-folded."""
    return case_folded(F.regexp_replace(strip(value), "^#+", ""))


def name_key(value: Column) -> Column:
    """Person name with single spaces, case-folded."""
    return case_folded(strip(F.regexp_replace(value, r"(?U)\s+", " ")))


def upload_folder(folder: Column) -> Column:
    """Struct of the parts of an upload folder name; NULL when it does not match."""

    def part(index: int) -> Column:
        return F.regexp_extract(folder, C.UPLOAD_FOLDER_PATTERN, index)

    stamp = F.concat(
        part(5), F.lit(" "), part(6), F.lit(", "), part(7), F.lit(" "),
        F.regexp_replace(part(8), r"^(\d{1,2})(\d{2})$", "$1:$2"),
        F.lit(" "), part(9),
    )
    parsed = F.struct(
        part(1).alias("person_id"),
        part(2).alias("lms_assignment_id"),
        part(3).alias("username"),
        part(4).alias("display_name"),
        F.try_to_timestamp(stamp, F.lit("MMM d, yyyy h:mm a"))
        .cast("timestamp_ntz")
        .alias("submitted_at"),
    )
    return F.when(folder.rlike(C.UPLOAD_FOLDER_PATTERN), parsed)


def archive_layout_of(top: Column) -> Column:
    """Which export a top-level directory name belongs to."""
    return (
        F.when(top.rlike(C.SCAN_EXPORT_PATTERN), "gradescope")
        .when(top.rlike(C.UPLOAD_FOLDER_PATTERN), "brightspace")
        .otherwise("unrecognized")
    )


def archive_series(name: Column) -> Column:
    """Struct (series, number) inferred from an archive file name, else NULL."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")
    word = F.regexp_replace(
        F.lower(F.regexp_extract(stem, C.ARCHIVE_NAME_PATTERN, 1)), r"\s", ""
    )
    series = F.lit(None).cast("string")
    for alias, code in C.SERIES_ALIASES.items():
        series = F.when(word == alias, code).otherwise(series)
    number = F.regexp_extract(stem, C.ARCHIVE_NAME_PATTERN, 2).try_cast("long")
    return F.when(word != "", F.struct(series.alias("series"), number.alias("number")))


def assignment_series(assignment_id: Column) -> Column:
    """Struct (series, number) of an assignment id, zero padding ignored."""
    series = F.upper(F.regexp_extract(assignment_id, C.ASSIGNMENT_ID_PATTERN, 1))
    number = F.regexp_extract(assignment_id, C.ASSIGNMENT_ID_PATTERN, 2).try_cast("long")
    return F.when(series != "", F.struct(series.alias("series"), number.alias("number")))


_ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?$"
)
_ISO_OFFSET = r"\d{2}:\d{2}.*(Z|[+-]\d{2}:\d{2})$"


def duration_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two ISO texts.

    NULL when one is unreadable or only one of them carries an offset.
    """
    readable = started.rlike(_ISO_SHAPE) & finished.rlike(_ISO_SHAPE)
    aware_start, aware_end = started.rlike(_ISO_OFFSET), finished.rlike(_ISO_OFFSET)

    def micros(kind: str) -> Column:
        return F.timestamp_diff("MICROSECOND", started.try_cast(kind), finished.try_cast(kind))

    return F.when(
        readable & (aware_start == aware_end),
        F.when(aware_start, micros("timestamp")).otherwise(micros("timestamp_ntz")) / 1e6,
    )


def _decimal_format(value: Column, pattern: str) -> Column:
    # Decimal patterns round the exact binary value half to even.
    return F.call_function("format_number", value, F.lit(pattern))


def format_general(value: Column) -> Column:
    """Six significant digits without trailing zeros, like the ``g`` format."""
    number = value.cast("double")
    scientific = _decimal_format(number, "0.#####E0")
    exponent = F.split(scientific, "E")[1].cast("int")
    text = F.concat(
        F.split(scientific, "E")[0],
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    for power in range(-4, 6):
        digits = "#" * (5 - power)
        pattern = "0." + digits if digits else "0"
        text = F.when(exponent == power, _decimal_format(number, pattern)).otherwise(text)
    return F.when(number.isNotNull(), text)


def format_grade(value: Column) -> Column:
    """Up to six decimals, trailing zeros and dot left out."""
    return _decimal_format(value.cast("double"), "0.######")


def _length_prefix(blob: Column) -> Column:
    return F.unhex(F.lpad(F.hex(F.length(blob).cast("long")), 16, "0"))


def parts_digest(parts: list[tuple[str, Column, Column | None]]) -> Column:
    """SHA-256 over labelled, length-prefixed blobs.

    Each part is ``(label, blob, present)``; a part whose ``present`` is false
    adds nothing, so an optional part that is absent leaves the digest as it was.
    """
    nul = F.unhex(F.lit("00"))
    pieces = [F.concat(F.encode(F.lit(C.PARTS_HASH_HEADER), "UTF-8"), nul)]
    for label, blob, present in parts:
        raw = blob.cast("binary")
        piece = F.concat(F.encode(F.lit(label), "UTF-8"), nul, _length_prefix(raw), raw)
        if present is not None:
            piece = F.when(present, piece).otherwise(F.unhex(F.lit("")))
        pieces.append(piece)
    return F.sha2(F.concat(*pieces), 256)


def ordered_blobs_digest(blobs: Column) -> Column:
    """Digest of an array of ``(label, content)`` structs in array order."""
    nul = F.unhex(F.lit("00"))
    start = F.concat(F.encode(F.lit(C.PARTS_HASH_HEADER), "UTF-8"), nul)

    def fold(acc: Column, part: Column) -> Column:
        raw = part["content"].cast("binary")
        return F.concat(acc, F.encode(part["label"], "UTF-8"), nul, _length_prefix(raw), raw)

    return F.sha2(F.aggregate(blobs, start, fold), 256)


def item_identity(
    config_identity: Column,
    environment: Column,
    rubric: Column | None = None,
    assignment_hash: Column | None = None,
    rubric_source_hash: Column | None = None,
    rubric_selection: Column | None = None,
    prior_gradings_hash: Column | None = None,
) -> Column:
    """Fold the config identity and an item's resolved inputs into one identity."""
    optional = [
        ("rubric", rubric),
        ("assignment", assignment_hash),
        ("rubric-source", rubric_source_hash),
        ("rubric-selection", rubric_selection),
        ("prior-gradings", prior_gradings_hash),
    ]
    parts: list[tuple[str, Column, Column | None]] = [
        ("config-identity", config_identity, None),
        ("environment", environment, None),
    ]
    parts += [
        (label, F.coalesce(blob.cast("binary"), F.unhex(F.lit(""))), blob.isNotNull())
        for label, blob in optional
        if blob is not None
    ]
    return parts_digest(parts)


def config_identity(
    config: Column,
    prompt: Column,
    verifier: Column,
    task_settings: Column,
    grading_schema: Column | None = None,
    rubric_override: Column | None = None,
) -> Column:
    """Identity of an experiment config with its prompt, verifier and task settings."""
    parts: list[tuple[str, Column, Column | None]] = [
        ("config", config, None),
        ("prompt", prompt, None),
        ("verifier", verifier, None),
    ]
    if grading_schema is not None:
        parts.append(("grading-schema", grading_schema, grading_schema.isNotNull()))
    parts.append(("task-toml", task_settings, None))
    if rubric_override is not None:
        parts.append(("rubric-override", rubric_override, rubric_override.isNotNull()))
    return parts_digest(
        [
            (label, F.coalesce(blob.cast("binary"), F.unhex(F.lit(""))), present)
            for label, blob, present in parts
        ]
    )


def sniff_kind(content: Column) -> Column:
    """File kind from the first 1024 bytes."""
    head = F.substring(content, 1, 1024)
    as_hex = F.hex(head)
    return (
        # Odd offsets in the hex text are byte boundaries, so pairs are matched.
        F.when(as_hex.rlike("^(?:..)*?255044462D"), "pdf")
        .when(as_hex.startswith("504B0304"), "zip")
        .when(as_hex.startswith("89504E470D0A1A0A"), "png")
        .when(as_hex.startswith("FFD8FF"), "jpeg")
        .when(F.length(head) == 0, "empty")
        .when(as_hex.rlike("^(?:..)*?00"), "binary")
        .when(~F.is_valid_utf8(head), "binary")
        .otherwise("text")
    )


def ink_fraction(histogram: Column) -> Column:
    """Share of pixels darker than the page background; 0.0 for an empty histogram."""
    def total(bins: Column) -> Column:
        return F.aggregate(bins, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))

    everything = total(histogram)
    return F.when(everything == 0, 0.0).otherwise(
        total(F.slice(histogram, 1, C.INK_PIXEL_MAX)) / everything
    )


def image_size_bytes(size: Column) -> Column:
    """Bytes of a size text such as ``13.2K``; anything unreadable is 0."""
    unit = F.substring(size, -1, 1)
    factor = (
        F.when(unit == "B", 1).when(unit == "K", 1024)
        .when(unit == "M", 1024 * 1024).when(unit == "G", 1024 * 1024 * 1024)
    )
    digits = F.regexp_extract(size, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*[BKMG]$", 1)
    return F.coalesce((digits.try_cast("double") * factor).try_cast("long"), F.lit(0).cast("long"))


def justification_paths(names: Column) -> Column:
    """Path of each named trial's justification below the data root."""
    return F.transform(
        names, lambda n: F.concat(F.lit("grading/"), n, F.lit("/" + C.JUSTIFICATION_PATH))
    )


def text_chars(value: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(value, r"(?U)\s", ""))


def is_close(a: Column, b: Column) -> Column:
    """Equal within the tolerance of authored point sums."""
    bound = F.greatest(
        C.SUMS_REL_TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(C.SUMS_ABS_TOLERANCE)
    )
    return F.abs(a - b) <= bound
