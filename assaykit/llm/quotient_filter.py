"""Counting quotient filters over n-grams of word ids: exact, sorted, mergeable counters.

A gram of ``k`` ids of ``bits`` bits each is a number of ``k * bits`` bits, held as ``k``
arrays ("limbs").  An invertible permutation scatters these numbers evenly.  The leading bits of
a permuted gram are its quotient, everything else its full remainder, so a filter loses
nothing: the gram is read back by the inverse.  A filter keeps its entries in order.  A stored
part of one (the entries that share their first ``bucket_bits``) holds a bit per quotient that occurs, a bit
per entry that ends the run of a quotient, the remainders without the quotient, and a counter of a byte,
with eight more for counts that need them.
"""

import struct

import numpy as np

ESCAPE = 255  # a counter that is written out at the end


def mask_of(bits):
    return np.uint64((1 << bits) - 1)


def _scrambled(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shift_of(limbs, at):
    """What a limb is moved by: a hash of all the others."""
    moved = None
    for i, limb in enumerate(limbs):
        if i != at:
            moved = _scrambled(limb + np.uint64(i + 1) if moved is None else moved ^ limb)
    return moved


def permuted(limbs, bits):
    """The gram scattered over its range; a single limb stays as it is."""
    limbs, mask = list(limbs), mask_of(bits)
    if len(limbs) > 1:
        for i in reversed(range(len(limbs))):
            limbs[i] = (limbs[i] + _shift_of(limbs, i)) & mask
    return limbs


def restored(limbs, bits):
    """The inverse of ``permuted``."""
    limbs, mask = list(limbs), mask_of(bits)
    if len(limbs) > 1:
        for i in range(len(limbs)):
            limbs[i] = (limbs[i] - _shift_of(limbs, i)) & mask
    return limbs


def collapsed(limbs, counts, bits):
    """Sorted distinct entries with their counts summed."""
    if not len(counts):
        return limbs, counts

    def arranged(order):
        ordered = [x[order] for x in limbs]
        differs = [x[1:] != x[:-1] for x in ordered]
        return ordered, np.concatenate([[True], np.logical_or.reduce(differs)])

    lead = limbs[0] << np.uint64(64 - bits)
    if len(limbs) > 1 and bits < 64:
        lead = lead | limbs[1] >> np.uint64(2 * bits - 64)
    order = np.argsort(lead, kind="stable")
    ordered, new = arranged(order)
    lead = lead[order]
    if (new[1:] & (lead[1:] == lead[:-1])).any():  # different grams of one leading word
        order = np.lexsort(limbs[::-1])
        ordered, new = arranged(order)
    starts = np.flatnonzero(new)
    return [x[starts] for x in ordered], np.add.reduceat(counts[order], starts)


def merged(filters, bits):
    """One sorted filter from several: ``[(limbs, counts), ...]``."""
    limbs = [np.concatenate(x) for x in zip(*(f[0] for f in filters))]
    return collapsed(limbs, np.concatenate([f[1] for f in filters]), bits)


def _bits_of(limb, width):
    whole = np.unpackbits(limb.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return whole[:, 64 - width :]


def _limb_of(table):
    padded = np.zeros((len(table), 64), np.uint8)
    padded[:, 64 - table.shape[1] :] = table
    return np.packbits(padded, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def encoded(limbs, counts, bits, bucket_bits):
    """The bytes of a sorted part whose entries agree in the first ``bucket_bits`` bits."""
    size = len(counts)
    left = bits - bucket_bits
    quotient_bits = min(max(size.bit_length() - 1, 0), left)
    low = left - quotient_bits
    quotient = ((limbs[0] & mask_of(left)) >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(size, np.int64)
    occupied = np.zeros(1 << quotient_bits, np.uint8)
    occupied[quotient] = 1
    ends = np.ones(size, np.uint8)
    ends[:-1] = quotient[1:] != quotient[:-1]
    remainders = np.concatenate([_bits_of(limbs[0], low), *(_bits_of(x, bits) for x in limbs[1:])], axis=1)
    small = np.minimum(counts, ESCAPE).astype(np.uint8)
    parts = (np.packbits(occupied), np.packbits(ends), np.packbits(remainders), small, counts[counts >= ESCAPE].astype("<i8"))
    return struct.pack("<IB", size, quotient_bits) + b"".join(p.tobytes() for p in parts)


def decoded(data, order, bits, bucket, bucket_bits):
    """``(limbs, counts)`` of a stored part of grams of ``order`` words."""
    size, quotient_bits = struct.unpack_from("<IB", data)
    at = struct.calcsize("<IB")
    left = bits - bucket_bits
    low = left - quotient_bits
    width = low + (order - 1) * bits

    def read(n, dtype=np.uint8):
        nonlocal at
        found = np.frombuffer(data, dtype, n, at)
        at += found.nbytes
        return found

    occupied = np.flatnonzero(np.unpackbits(read(-(-(1 << quotient_bits) // 8)), count=1 << quotient_bits))
    ends = np.unpackbits(read(-(-size // 8)), count=size)
    remainders = np.unpackbits(read(-(-size * width // 8)), count=size * width).reshape(size, width)
    counts = read(size).astype(np.int64)
    large = counts == ESCAPE
    counts[large] = read(int(large.sum()), "<i8")
    run = np.cumsum(ends) - ends
    first = np.zeros(size, np.uint64)
    if bucket_bits:
        first |= np.uint64(bucket) << np.uint64(left)
    if quotient_bits:
        first |= occupied[run].astype(np.uint64) << np.uint64(low)
    first |= _limb_of(remainders[:, :low])
    others = [_limb_of(remainders[:, low + i * bits : low + (i + 1) * bits]) for i in range(order - 1)]
    return [first, *others], counts
