"""Containers built by hand here: several tracks, both kinds of sizes and offsets, and faults."""

import random
import struct

import pytest

from tallyrill.llm import media_columns as M


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, *parts, version=0):
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def numbers(kind, values):
    return struct.pack(f">I{len(values)}{kind}", len(values), *values)


def track(codec, sizes, chunks, keys, start, wide=False, small=0, version=0, leave=()):
    """A track whose samples lie from ``start`` on; ``chunks``: samples in each.  (box, offsets)."""
    offsets, at, k = [], start, 0
    places = []
    for n in chunks:
        places.append(at)
        for s in sizes[k : k + n]:
            offsets.append(at)
            at += s
        k += n
        at += 5  # a gap between chunks
    runs = [(c + 1, n, 1) for c, n in enumerate(chunks) if not c or n != chunks[c - 1]]
    if small == 4:
        padded = [*sizes, 0][: len(sizes) + len(sizes) % 2]
        table = full(b"stz2", b"\0\0\0\4", struct.pack(">I", len(sizes)), bytes(a << 4 | b for a, b in zip(padded[::2], padded[1::2])))
    elif small:
        table = full(b"stz2", bytes([0, 0, 0, small]), struct.pack(f">I{len(sizes)}{'B' if small == 8 else 'H'}", len(sizes), *sizes))
    else:
        table = full(b"stsz", struct.pack(">I", 0), numbers("I", sizes))
    boxes = {
        b"stsd": full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), b"stts": full(b"stts", struct.pack(">III", 1, len(sizes), 10)),
        b"stsc": full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]), b"stsz": table,
        b"stco": full(b"co64", numbers("Q", places)) if wide else full(b"stco", numbers("I", places)),
    }
    if keys is not None:
        boxes[b"stss"] = full(b"stss", numbers("I", [k + 1 for k in keys]))
    stbl = box(b"stbl", *[b for kind, b in boxes.items() if kind not in leave])
    mdhd = full(b"mdhd", struct.pack(">QQIQHH" if version else ">IIIIHH", 0, 0, 90, 10 * len(sizes), 0, 0), version=version)
    return box(b"trak", box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"vide", bytes(12)), box(b"minf", stbl))), offsets, at


def test_tracks_have_their_own_tables():
    one, places_one, end = track(b"avc1", [7] * 35, [35], None, 8)
    two, places_two, end = track(b"mp4a", [3, 4, 5, 6], [3, 1], [0, 2, 3], end, wide=True, version=1)
    media = box(b"mdat", bytes(end)) + box(b"moov", box(b"udta", b"any bytes"), one, two)
    first, second = M.read_tracks(media)
    assert (first["codec"], second["codec"], first["handler"]) == ("avc1", "mp4a", "vide")
    assert first["keyframes"].tolist() == list(range(35)) and second["keyframes"].tolist() == [0, 2, 3]
    assert first["offsets"].tolist() == places_one and second["offsets"].tolist() == places_two
    assert second["sizes"].tolist() == [3, 4, 5, 6] and (second["timescale"], second["ticks"], second["table_ticks"]) == (90, 40, 40)
    assert M.read_container(media)["codec"] == "avc1"


@pytest.mark.parametrize("small", [0, 4, 8, 16])
def test_random_tracks(small):
    rnd = random.Random(small)
    for _ in range(50):
        chunks = [rnd.randint(1, 6) for _ in range(rnd.randint(1, 8))]
        sizes = [rnd.randint(0, 15) for _ in range(sum(chunks))]
        keys = sorted(rnd.sample(range(len(sizes)), rnd.randint(1, len(sizes))))
        built, places, end = track(b"av01", sizes, chunks, keys, 8, small=small, wide=rnd.random() < 0.5)
        payload = rnd.randbytes(end)
        (got,) = M.read_tracks(box(b"mdat", payload) + box(b"moov", built))
        assert got["offsets"].tolist() == places and got["sizes"].tolist() == sizes and got["keyframes"].tolist() == keys
        whole = box(b"mdat", payload)
        assert M.stored_payload(whole, got) == b"".join(whole[a : a + n] for a, n in zip(places, sizes))


@pytest.mark.parametrize("kind", [b"stsd", b"stts", b"stsc", b"stsz", b"stco"])
def test_missing_tables_are_named(kind):
    built, _, end = track(b"avc1", [1, 2], [2], None, 8, leave=(kind,))
    with pytest.raises(ValueError, match=kind.decode()):
        M.read_tracks(box(b"mdat", bytes(end)) + box(b"moov", built))


def test_faults_are_refused():
    built, _, end = track(b"avc1", [9, 9], [2], [1], 8)
    far, _, _ = track(b"avc1", [9, 9], [2], [1], 10**6)
    for media in (box(b"moov", far), box(b"moov", built) + box(b"moof"), b"\0\0\0\7free", box(b"free")):
        with pytest.raises(ValueError):
            M.read_container(media)
    bad, _, end = track(b"avc1", [9, 9], [2], [2], 8)
    with pytest.raises(ValueError, match="keyframe"):
        M.read_tracks(box(b"mdat", bytes(end)) + box(b"moov", bad))
