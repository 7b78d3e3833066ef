"""TIFF as a media column: an image reader that emits one row per page, and a writer for 8-bit samples.

The reader walks the chain of image directories (either byte order), takes strips or tiles, chunky or in planes, decodes no
compression, PackBits, LZW and deflate, undoes the horizontal predictor (2), and lays 8- or 16-bit samples out row by row. Each
page gives its size, tags, pixel statistics and an average hash. A page that can't be read (unknown compression, a tag of a type
that can't be a number, missing or short strips, more pixels than its bytes can hold) gives a row with `error` set, and the pages
after it are still read; a chain that loops or leaves the file ends with such a row. No block is decompressed beyond its size.

Edge cases: null media give no page; empty or damaged media give one row with page 0 and an error; media and texts of any length
are read whole; null texts are stored as empty ones; repeated rows and repeated or null ids are read alike, each for itself; an
empty table gives no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stimfuse.llm.common import map_batches, slices

#: Fixed values of the TIFF 6.0 specification: tag numbers, field sizes and compression numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: No compression above makes more than this many bytes of one.
MOST = 2600
#: How text_features() lays a payload out, by its CRC-32: compression, predictor, side of the tiles (0: strips). Bytes of a page.
LAYOUTS, PAGE_BYTES = ((DEFLATE, 2, 0), (PACKBITS, 1, 32), (LZW, 1, 0), (DEFLATE, 2, 32)), 1 << 20

PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, mean double, stddev double, average_hash string, pixels_sha256 string, error string"


def packbits_decode(data: bytes, most: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more bytes are packed, all else is literal."""
    a = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(a)))
    out, at = bytearray(), 0

    def literal(to: int) -> None:
        for k in range(at, to, 128):
            out.append(min(128, to - k) - 1)
            out.extend(data[k : min(k + 128, to)])

    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        literal(start)
        for k in range(0, size, 128):
            n = min(128, size - k)
            out += bytes((257 - n if n > 1 else 0, data[start]))
        at = start + size
    literal(len(data))
    return bytes(out)


#: Bits of the n-th code after a clear code (the table has 258 entries then, and one more with each code but the first).
_WIDTHS = np.array([min(12, (258 + k).bit_length()) for k in range(4096 - 258 + 2)])
_BASE = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, most: int) -> bytes:
    """Most significant bit first; code 256 clears the table, 257 ends; widths grow one code early.

    As widths follow from the number of codes since the last clear code, the codes up to the next one are cut out together."""
    byte = np.frombuffer(data + bytes(3), np.uint8).astype(np.uint32)
    at, end, out, made = 0, 8 * len(data), [], 0
    ends = np.cumsum(_WIDTHS)
    while at < end and made < most:
        n = int(np.searchsorted(ends, end - at, side="right"))
        if not n:
            break
        first = at + ends[:n] - _WIDTHS[:n]
        word = byte[first >> 3] << 16 | byte[(first >> 3) + 1] << 8 | byte[(first >> 3) + 2]
        codes = word >> (24 - (first & 7) - _WIDTHS[:n]) & ((1 << _WIDTHS[:n]) - 1)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        size = int(stop[0]) if len(stop) else n
        table, last = list(_BASE), b""
        for code in codes[:size].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("LZW code beyond the table")
            if last:
                table.append(last + entry[:1])
            out.append(entry)
            made += len(entry)
            last = entry
        if not len(stop) or codes[size] == 257:
            break
        at += int(ends[size])
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """The codes of each part up to a full table, put together bit by bit."""
    parts, codes, code, size, table = [], [], -1, 258, {}
    for c in data:
        key = code << 8 | c
        known = table.get(key) if code >= 0 else c
        if known is not None:
            code = known
            continue
        codes.append(code)
        table[key] = size
        size += 1
        code = c
        if size >= 4094:
            parts.append([*codes, 256])
            codes, size, table = [], 258, {}
    parts.append([*codes, *([code] if code >= 0 else []), 257])
    flat = np.array([256] + [x for p in parts for x in p], ">u2")
    widths = np.concatenate([[9], *[_WIDTHS[: len(p)] for p in parts]])
    bits = np.unpackbits(flat.view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16)[None, :] >= 16 - widths[:, None]]).tobytes()


def _unpack(data: bytes, compression: int, most: int) -> bytes:
    """The bytes of a strip or tile; decompression stops when there are `most` of them."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(most, 1))
    raise ValueError(f"compression {compression} is not known")


BAD = (ValueError, KeyError, IndexError, struct.error, zlib.error, OverflowError, MemoryError)


def _directories(data: bytes):
    """(byte order, tags) of each page, in the order of the chain; tags of types that are no numbers are None, an error takes the place of tags that can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    if not at:
        raise ValueError("the file has no page")
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        after = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        try:
            tags: dict | Exception = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                if kind not in FIELD:
                    tags[tag] = None
                    continue
                form = f"{order}{count}{FIELD[kind]}"
                where = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                tags[tag] = struct.unpack_from(form, data, where)
        except BAD as e:
            tags = e
        yield order, tags
        at = after


def numbers(tags: dict, tag: int, default: tuple | None = None) -> tuple:
    """The numbers of a tag, which is present or has a default."""
    found = tags.get(tag, default)
    if not found or min(found) < 0:
        raise ValueError(f"tag {tag} is missing or not a number")
    return found


def _block(raw: bytes, rows: int, cols: int, samples: int, kind: np.dtype, predictor: int) -> np.ndarray:
    if len(raw) < rows * cols * samples * kind.itemsize:
        raise ValueError("a strip or tile is too short")
    a = np.frombuffer(raw, kind, rows * cols * samples).reshape(rows, cols, samples)
    if predictor == 2:
        return np.cumsum(a, axis=1, dtype=kind.newbyteorder("="))
    if predictor != 1:
        raise ValueError(f"predictor {predictor} is not known")
    return a


def page_pixels(data: bytes, order: str, tags: dict) -> np.ndarray:
    """The samples of one page: (height, width, samples)."""
    one = lambda tag, *default: numbers(tags, tag, default or None)[0]
    width, height, samples, bits, planes = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(PLANES, 1)
    if bits not in (8, 16) or len(set(numbers(tags, BITS, (1,)))) > 1:
        raise ValueError(f"{bits} bits a sample are not known")
    if not width or not height or not samples or planes not in (1, 2):
        raise ValueError("the page has no pixels or unknown planes")
    kind = np.dtype(f"{order}u{bits // 8}")
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if width * height * samples * kind.itemsize > MOST * len(data):
        raise ValueError("the page has more pixels than the file can hold")
    tiled = TILE_OFFSETS in tags
    if tiled:
        cols, rows = one(TILE_WIDTH), one(TILE_HEIGHT)
        offsets, sizes = numbers(tags, TILE_OFFSETS), numbers(tags, TILE_BYTES)
    else:
        cols, rows = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, sizes = numbers(tags, STRIP_OFFSETS), numbers(tags, STRIP_BYTES)
    if not cols or not rows:
        raise ValueError("strips or tiles have no size")
    across, down, depth = -(-width // cols), -(-height // rows), samples if planes == 2 else 1
    if len(offsets) != len(sizes) or len(offsets) < across * down * depth:
        raise ValueError("strips or tiles are missing")
    held = samples // depth
    if cols * rows * held * kind.itemsize > MOST * max(len(data), 1):
        raise ValueError("a strip or tile is larger than the file can hold")
    out = np.empty((height, width, samples), kind.newbyteorder("="))
    for k in range(across * down * depth):
        plane, place = divmod(k, across * down)
        y, x = place // across * rows, place % across * cols
        n = rows if tiled else min(rows, height - y)
        raw = _unpack(data[offsets[k] : offsets[k] + sizes[k]], compression, n * cols * held * kind.itemsize)
        block = _block(raw, n, cols, held, kind, predictor)
        out[y : y + n, x : x + cols, plane : plane + held if depth > 1 else samples] = block[: height - y, : width - x]
    return out


def average_hash(a: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is brighter than the page; a page of fewer rows or columns has cells without pixels, which are not."""
    rows, cols = np.linspace(0, a.shape[0], 9).astype(int), np.linspace(0, a.shape[1], 9).astype(int)
    n_rows, n_cols = np.diff(rows), np.diff(cols)
    flat = a[..., 0] if a.shape[2] == 1 else a.sum(axis=2, dtype=np.int64)
    cells = np.zeros((8, 8), np.int64)
    across = np.add.reduceat(flat, rows[:-1][n_rows > 0], axis=0, dtype=np.int64)
    cells[np.ix_(n_rows > 0, n_cols > 0)] = np.add.reduceat(across, cols[:-1][n_cols > 0], axis=1)
    return np.packbits((cells * a.shape[0] * a.shape[1] > np.outer(n_rows, n_cols) * int(cells.sum())).ravel()).tobytes().hex()


def decoded(data: bytes):
    """(tags, pixels) of each page, or (None, error) of one that can't be read; nothing comes after an error of the chain itself."""
    try:
        for order, tags in _directories(data):
            try:
                if isinstance(tags, Exception):
                    raise tags
                yield tags, page_pixels(data, order, tags)
            except BAD as e:
                yield None, e
    except BAD as e:
        yield None, e


def read_pages(data: bytes):
    """One tuple of PAGE_SCHEMA per page."""
    for k, (tags, a) in enumerate(decoded(data)):
        if tags is None:
            yield (k, *[None] * 10, str(a)[:200] or type(a).__name__)
            continue
        one = lambda tag, default, tags=tags: int(numbers(tags, tag, (default,))[0])
        yield (k, a.shape[1], a.shape[0], a.shape[2], one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), float(a.mean()), float(a.std()), average_hash(a), hashlib.sha256(a.tobytes()).hexdigest(), None)


def write_tiff(pages_: list[bytes], width: int, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, strip_bytes: int = 1 << 16) -> bytes:
    """A little-endian file of 8-bit grey pages, in strips or square tiles; each page's length is a multiple of width."""
    pack = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}[compression]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for pixels in pages_:
        height = len(pixels) // width
        a = np.frombuffer(pixels, np.uint8).reshape(height, width)
        cols, rows = (tile, tile) if tile else (width, max(1, strip_bytes // width))
        if tile:
            a = np.pad(a, ((0, -height % tile), (0, -width % tile)))
        offsets, sizes = [], []
        for y in range(0, a.shape[0], rows):
            for x in range(0, a.shape[1], cols):
                block = a[y : y + rows, x : x + cols]
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                offsets.append(len(out))
                out += pack(block.tobytes())
                sizes.append(len(out) - offsets[-1])
        out += bytes(len(out) & 1)
        shape = [(TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (TILE_OFFSETS, offsets), (TILE_BYTES, sizes)] if tile else [(STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [rows]), (STRIP_BYTES, sizes)]
        tags = sorted([(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor]), *shape])
        struct.pack_into("<I", out, link, len(out))
        arrays_at = len(out) + 2 + 12 * len(tags) + 4
        head, arrays = struct.pack("<H", len(tags)), b""
        for tag, values in tags:
            one = len(values) == 1
            head += struct.pack("<HHII", tag, 4, len(values), values[0] if one else arrays_at + len(arrays))
            arrays += b"" if one else struct.pack(f"<{len(values)}I", *values)
        link = len(out) + len(head)
        out += head + bytes(4) + arrays
    return bytes(out)


def pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of each TIFF in media_col: the id and the columns of PAGE_SCHEMA."""

    def run(b: pa.RecordBatch):
        for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = [] if data is None else [(key, *r) for r in read_pages(data)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    names = [x.split(" ")[0] for x in PAGE_SCHEMA.split(", ")]
    NAMES = [id_col, *names]
    TYPES = [pa.int64(), *[{"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[x.split(" ")[1]] for x in PAGE_SCHEMA.split(", ")]]
    return map_batches(df.select(id_col, media_col), run, f"`{id_col}` bigint, {PAGE_SCHEMA}")


def stored(text: str | None, width: int = 64) -> bytes:
    """A whole text as a TIFF file: pages of PAGE_BYTES, in the layout that its CRC-32 picks; null is the empty text."""
    payload = padded((text or "").encode("utf-8", "surrogatepass"), width)
    step = PAGE_BYTES // width * width
    return write_tiff([payload[k : k + step] for k in range(0, len(payload), step)], width, *LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)])


def store_texts(df: DataFrame, width: int = 64) -> DataFrame:
    """Each whole text as a TIFF file: (doc_id, media binary)."""

    def run(b: pa.RecordBatch):
        texts = b.column(1).to_pylist()
        for lo, hi in slices(texts):
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([stored(t, width) for t in texts[lo:hi]], pa.large_binary()).cast(pa.binary())], names=["doc_id", "media"])

    return map_batches(df.select("doc_id", "text"), run, "doc_id bigint, media binary")


def padded(raw: bytes, to: int = 64) -> bytes:
    """Bytes 0 up to a positive multiple of `to`."""
    return raw + bytes(to - len(raw) if len(raw) < to else -len(raw) % to)


def text_features(df: DataFrame, width: int = 64) -> DataFrame:
    """Store each whole text as TIFF, read the stored bytes back and give digests of both and features of the page."""

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(b: pa.RecordBatch):
        rows = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            media = stored(text, width)
            found = [a for tags, a in decoded(media) if tags is not None]
            back = b"".join(a.tobytes() for a in found)
            total = sum(int(a.sum(dtype=np.int64)) for a in found)
            feature = f"pages={len(found)} {width}x{sum(a.shape[0] for a in found)} mean={total / len(back):.6f} min={min(a.min() for a in found)} max={max(a.max() for a in found)} ahash={'-'.join(map(average_hash, found))}"
            rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_batches(df.select("doc_id", "text"), run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
