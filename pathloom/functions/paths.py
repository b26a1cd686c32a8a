"""Path text: slashes, roots, normal and relative forms, ages and sizes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.schemas import ENTRY_DEFAULT_TIME, STORAGE_ROOTS

_BLANKS = " \t\n\r\x0b\x0c"


def conform_slashes(col: Column) -> Column:
    return F.replace(col, F.lit("\\"), F.lit("/"))


def _map_root_text(text: Column, root: str, roots: Mapping[str, str]) -> Column:
    text = conform_slashes(text)
    text = F.when(F.startswith(text, F.lit("http")), text).otherwise(
        F.regexp_replace(text, "/{2,}", "/")
    )
    for other in roots.values():
        if other != root:
            text = F.replace(text, F.lit(other), F.lit(root))
    return text


def map_roots(
    col: Column, dtype: T.DataType, root: str, roots: Mapping[str, str] = STORAGE_ROOTS
) -> Column:
    """Known storage roots replaced by ``root``, also inside arrays, maps and structs."""
    if isinstance(dtype, T.StringType):
        return _map_root_text(col, root, roots)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: map_roots(x, dtype.elementType, root, roots))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: map_roots(v, dtype.valueType, root, roots))
    if isinstance(dtype, T.StructType):
        return F.when(
            col.isNotNull(),
            F.struct(*[map_roots(col[f.name], f.dataType, root, roots).alias(f.name) for f in dtype]),
        )
    return col


def entry_time(text: Column | None = None, now: Column | None = None) -> Column:
    """Entry time of a row: its own text where it is a time, else the default time.

    Without a text it is the clock, ``now`` or the current time, in whole seconds.
    """
    if text is None:
        return F.date_trunc("second", F.current_timestamp() if now is None else now)
    known = F.try_to_timestamp(text.cast("string"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(known, F.lit(ENTRY_DEFAULT_TIME).cast("timestamp"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _walk(text: Column) -> Column:
    rooted = F.startswith(text, F.lit("/"))
    # blank and dot parts go first; what is left is cut at its ``..``, each of which takes a part off what stands before
    slashed = F.regexp_replace(F.concat(F.lit("/"), text, F.lit("/")), r"(?:/\.?)+/", "/")

    def up(done: Column) -> Column:
        name = F.length(F.substring_index(done, "/", -1))
        return (
            F.when(F.endswith(done, F.lit("/..")) | ((done == "") & ~rooted), F.concat(done, F.lit("/..")))
            .when(done == "", done)
            .otherwise(F.left(done, F.length(done) - name - 1))
        )

    def walked(cut: Column) -> Column:
        return F.aggregate(F.slice(cut, F.lit(2), F.size(cut)), F.get(cut, 0), lambda done, part: F.concat(up(done), part))

    def shown(done: Column) -> Column:
        bare = F.btrim(done, F.lit("/"))
        return F.when(rooted, F.concat(F.lit("/"), bare)).when(bare == "", F.lit(".")).otherwise(bare)

    return let(let(F.split(slashed, r"/\.\.(?=/)"), walked), shown)


def normalize_path(path: Column) -> Column:
    """``.`` and ``..`` and doubled slashes worked out; ``/`` as the only separator.

    Most paths are in normal form already and skip the walk over their parts.
    """
    messy = r"(?:^|/)\.{1,2}(?:/|$)|//"
    return let(
        conform_slashes(path),
        lambda t: F.when(t.rlike(messy) | ((F.length(t) > 1) & F.endswith(t, F.lit("/"))), _walk(t)).otherwise(t),
    )


def _relative(pair: Column) -> Column:
    src, dst = pair["src"], pair["dst"]
    same = F.zip_with(src, dst, lambda a, b: F.coalesce(a == b, F.lit(False)))
    shorter = F.least(F.size(src), F.size(dst))
    at = F.array_position(same, F.lit(False)).cast("int")
    fork = F.when((at == 0) | (at > shorter), shorter).otherwise(at - 1)

    def build(n: Column) -> Column:
        ups = F.array_repeat(F.lit(".."), F.greatest(F.size(dst) - n - 1, F.lit(0)))
        rest = F.slice(src, n + 1, F.greatest(F.size(src) - n, F.lit(0)))
        return F.array_join(F.concat(ups, rest), "/")

    return let(let(fork, build), lambda text: F.when(text == "", F.lit(".")).otherwise(text))


def relative_path(source: Column, dest: Column) -> Column:
    """Path of ``source`` seen from the folder of ``dest``."""
    pair = F.struct(F.split(source, "/").alias("src"), F.split(dest, "/").alias("dst"))
    return F.when(source.isNotNull() & dest.isNotNull(), let(pair, _relative))


def link_in_package(link: Column, root: str) -> Column:
    """Normal form of a link relative to the package root."""
    base = root.rstrip("/") + "/"
    here = F.lit(base + "-")
    return let(
        normalize_path(link),
        lambda p: F.when(F.startswith(p, F.lit("/")), relative_path(p, here)).otherwise(p),
    )


def move_root(path: Column, root: str, new_root: str) -> Column:
    """First occurrence of ``root`` replaced by ``new_root``."""
    at = F.instr(path, F.lit(root))
    return F.when(
        at > 0,
        F.concat(
            F.substring(path, F.lit(1), at - 1), F.lit(new_root),
            F.substring(path, at + len(root), F.length(path)),
        ),
    ).otherwise(path)


def hash_key(
    col: Column, dtype: T.DataType, roots: Mapping[str, str] | None = None,
    drop_slashes: bool = False, force_text: bool = False,
) -> Column:
    """SHA-256 of the trimmed text; ``noHash`` for columns that hold no text."""
    if not isinstance(dtype, T.StringType) and not force_text:
        return F.lit("noHash")
    text = col.cast("string")
    for root in (roots or {}).values():
        text = F.replace(text, F.lit(root), F.lit(""))
    if drop_slashes:
        text = F.translate(text, "/\\", "")
    return F.coalesce(F.sha2(F.btrim(text, F.lit(_BLANKS)), 256), F.lit("noHash"))


def is_digest(text: Column) -> Column:
    """Whether a text is 64 lower-case hex digits."""
    return (F.length(text) == 64) & text.rlike("^[0-9a-f]{64}")


def pack_digest(text: Column) -> Column:
    """A text as bytes, one to one: 64 hex digits as the 32 bytes they stand for, else as it is, behind a mark.

    Digests among each other keep their order.
    """
    return F.when(is_digest(text), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def unpack_digest(packed: Column) -> Column:
    rest = F.substring(packed, F.lit(2), F.octet_length(packed))
    digest = F.substring(packed, F.lit(1), F.lit(1)) == F.lit(b"\x01")
    return F.when(digest, F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def node_id(parent: Column, child: Column) -> Column:
    return F.sha2(F.concat_ws("-", parent, child), 256)


def scan_id(paths: Column, time: Column) -> Column:
    """Id of a scan: hash of its roots and its time as JSON."""
    return F.sha2(F.to_json(F.struct(paths.alias("paths"), time.alias("time"))), 256)


def size_text(size: Column) -> Column:
    """Bytes as ``1.46 KB``; ``0 B`` for bad or non-positive values."""
    number = size.cast("string").try_cast("bigint")
    text = F.lit("0 B")
    units = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
    for power, unit in enumerate(units):
        scaled = F.bround(number / F.lit(float(1024**power)), 2)
        text = F.when(
            number >= F.lit(1024**power), F.concat(scaled.cast("string"), F.lit(" " + unit))
        ).otherwise(text)
    return text


def size_text_fixed(size: Column) -> Column:
    """Bytes with two decimals, up to PB."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    text = None
    for power, unit in reversed(list(enumerate(units))):
        scaled = F.format_string("%.2f " + unit, F.bround(size.cast("double") / float(1024**power), 2))
        text = scaled if text is None else F.when(size < float(1024 ** (power + 1)), scaled).otherwise(text)
    return text


def relative_age(time: Column, now: Column) -> Column:
    """How long ago, in words."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(time)
    days = F.floor(seconds / 86400)
    rest = seconds - days * 86400
    return (
        F.when(time.isNull(), F.lit("Unknown"))
        .when(days > 0, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(rest > 3600, F.concat(F.floor(rest / 3600).cast("string"), F.lit(" hours ago")))
        .when(rest > 60, F.concat(F.floor(rest / 60).cast("string"), F.lit(" mins ago")))
        .otherwise(F.lit("Just now"))
    )


def smb_forms(text: Column) -> Column:
    """Share text as ``{unix, windows}`` forms, protocol removed."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"^[^:]*:", ""))
    parts = F.filter(F.split(bare, r"[\\/]"), lambda p: p != "")
    return F.struct(
        F.array_join(parts, "/").alias("unix"),
        F.concat(F.lit("\\\\"), F.array_join(parts, "\\")).alias("windows"),
    )


def nfs_form(text: Column) -> Column:
    bare = F.trim(text)
    return F.when(F.contains(bare, F.lit(":")), bare).otherwise(
        F.replace(bare, F.lit("/"), F.lit(":/"))
    )


def glob_to_regex(pattern: str) -> str:
    """A shell wildcard as an anchored regular expression; ``*`` also crosses slashes."""
    special = {"*": ".*", "?": "."}
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = close
        elif c in special:
            out.append(special[c])
        else:
            out.append(c if c.isalnum() or c in "_/ -" else "\\" + c)
        i += 1
    return "(?s)^" + "".join(out) + "$"
