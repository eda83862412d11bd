"""Counting the character n-grams of many texts at once, in the tasks that hold them.

Characters become numbers of a batch's own alphabet, so a gram and its text fit one 64-bit key: sorting the keys counts them. Texts come sorted
by id, so what belongs to one id is adjacent; an id with more text than a batch is counted alone, piece by piece.
"""

import pickle
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Characters that are counted at once; a key takes 8 bytes, and each character starts one gram per length.
BATCH = 1 << 20
#: Rows per Arrow batch that goes back to Spark, and of a batch from Spark that become Python strings at once.
ROWS, TEXTS = 1 << 18, 256
#: Texts of a batch whose numbers must fit 16 bits.
MOST = 1 << 15


def _by_hand(texts, starts, n_min, n_max):
    """As `count`, for texts that don't fit keys: very large alphabets, and NUL characters, which end a numpy string."""
    grams = Counter((t[i:i + n], k) for k, (t, last) in enumerate(zip(texts, starts)) for n in range(n_min, n_max + 1)
                    for i in range(min(last, len(t) - n + 1)))
    order = sorted(grams)
    names = list(dict.fromkeys(g for g, _ in order))
    place = {g: i for i, g in enumerate(names)}
    return (pa.array(names, pa.string()), np.array([place[g] for g, _ in order], np.int64), np.array([k for _, k in order], np.int64),
            np.array([grams[o] for o in order], np.int64))


def count(texts, starts, n_min, n_max):
    """[(grams, which, text, tf)]: distinct grams, and per distinct (gram, text) the positions of both and the number of occurrences.

    `starts[k]` says how many positions of text k may start a gram.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if not points.size:
        return []
    seen = np.zeros(int(points.max()) + 1, np.bool_)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    bits, text_bits = len(alphabet).bit_length(), len(texts).bit_length()
    if seen[0] or n_max * bits + text_bits > 63:
        if len(texts) == 1:
            return [_by_hand(texts, starts, n_min, n_max)]
        half = len(texts) // 2
        tail = [(g, w, k + half, n) for g, w, k, n in count(texts[half:], starts[half:], n_min, n_max)]
        return count(texts[:half], starts[:half], n_min, n_max) + tail
    code = np.zeros(len(seen), np.int64)
    code[alphabet] = np.arange(1, len(alphabet) + 1)
    codes, total = code[points], len(points)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(ends, sizes) - np.arange(total)  # characters from here to the end of the text
    may = np.arange(total) < np.repeat(ends - sizes + np.minimum(np.array(starts, np.int64), sizes), sizes)
    key, found = codes << (bits * (n_max - 1) + text_bits), []
    key |= owner
    for n in range(1, n_max + 1):
        if n > 1:
            key[:max(total - n + 1, 0)] |= codes[n - 1:] << (bits * (n_max - n) + text_bits)
        if n >= n_min:
            found.append(key[may & (left >= n)])
    keys = np.concatenate(found)
    keys.sort()
    if not keys.size:
        return []
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    tf = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    gram, text = keys >> text_bits, keys & ((1 << text_bits) - 1)
    new = np.concatenate(([True], gram[1:] != gram[:-1]))
    which = np.cumsum(new) - 1
    shifts = bits * np.arange(n_max - 1, -1, -1)
    points_of = np.concatenate(([0], alphabet)).astype(np.uint32)
    names = points_of[(gram[new][:, None] >> shifts) & ((1 << bits) - 1)]
    names = pa.array(np.ascontiguousarray(names).view(f"<U{n_max}").ravel(), pa.string())
    return [(names, which, text, tf)]


def _rows(batch):
    for at in range(0, batch.num_rows, TEXTS):
        some = batch.slice(at, TEXTS)
        yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist())


def _pieces(text, chunk, overlap):
    for at in range(0, len(text), chunk):
        yield text[at:at + chunk + overlap]


def _counted(batches, n_min, n_max, chunk, most=None):
    """Per batch of texts: (ids, list of counts); `batches` hold (id, text) sorted by id.

    With `most`, ids without text come too, and a batch has at most that many ids.
    """
    ids, texts, held = [], [], 0  # whole ids; an id has one entry per row
    group, group_id, size = [], None, 0

    def alone(name, rows):
        total = Counter()
        for text in rows:
            for piece in _pieces(text, chunk, n_max - 1):
                for names, which, _, tf in count([piece], [chunk], n_min, n_max):
                    total.update(dict(zip(names.to_pylist(), np.bincount(which, weights=tf).astype(np.int64).tolist())))
        return [name], [(pa.array(list(total), pa.string()), np.arange(len(total)), np.zeros(len(total), np.int64),
                         np.array(list(total.values()), np.int64))] if total else []

    def whole():
        # rows of one id are separate texts whose grams are counted together
        parts, owners, names = [], [], []
        for name, rows in zip(ids, texts):
            parts += rows
            owners += [len(names)] * len(rows)
            names.append(name)
        counts = count(parts, [len(t) for t in parts], n_min, n_max)
        if owners != list(range(len(names))):
            counts = [_joined(c, np.array(owners, np.int64), len(names)) for c in counts]
            if len(counts) > 1:
                counts = [_united(counts, len(names))]
        return names, counts

    def close():
        nonlocal held
        if size > chunk:
            yield alone(group_id, group)
        elif group or most and started:
            ids.append(group_id)
            texts.append(group)
            held += size
            if held >= chunk or len(ids) == most:
                yield whole()
                ids.clear(), texts.clear()
                held = 0

    started = False
    for batch in batches:
        for name, text in _rows(batch):
            if not started or name != group_id:
                yield from close()
                group, group_id, size, started = [], name, 0, True
            if text:
                group.append(text)
                size += len(text)
    yield from close()
    if ids:
        yield whole()


def _joined(counted, owners, n):
    names, which, text, tf = counted
    pair, at = np.unique(which * n + owners[text], return_inverse=True)
    return names, pair // n, pair % n, np.bincount(at, weights=tf).astype(np.int64)


def _united(counts, n):
    """Counts of the halves of a batch as one, for ids with rows in both."""
    names = pa.concat_arrays([c[0] for c in counts]).dictionary_encode()
    place, base, which = names.indices.to_numpy(), 0, []
    for c in counts:
        which.append(place[base + c[1]])
        base += len(c[0])
    parts = [np.concatenate(which).astype(np.int64), *(np.concatenate([c[i] for c in counts]) for i in (2, 3))]
    return _joined((names.dictionary, *parts), np.arange(n), n)


def _batches(columns, names):
    for at in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([c.slice(at, ROWS) for c in columns], names=names)


def per_gram(n_min, n_max, chunk, id_type):
    """Task function: (id, text) sorted by id to (gram, entries), a row per gram and batch of texts; entries are (id, tf), one per id."""
    def run(batches):
        for ids, counts in _counted(batches, n_min, n_max, chunk):
            ids = pa.array(ids, id_type)
            for names, which, text, tf in counts:
                starts = np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(which)).astype(np.int32)  # `which` rises
                entries = pa.StructArray.from_arrays([ids.take(pa.array(text)), pa.array(tf, pa.int64())], ["id", "tf"])
                yield from _batches([names, pa.ListArray.from_arrays(pa.array(starts), entries)], ["gram", "entries"])
    return run


def per_batch(n_min, n_max, chunk):
    """Task function: (id, text) sorted by id to (gram, df, total), a row per gram and batch of texts."""
    def run(batches):
        for _, counts in _counted(batches, n_min, n_max, chunk):
            for names, which, _, tf in counts:
                df, total = np.bincount(which), np.bincount(which, weights=tf).astype(np.int64)
                yield from _batches([names, pa.array(df, pa.int64()), pa.array(total, pa.int64())], ["gram", "df", "total"])
    return run


def per_place(n_min, n_max, chunk):
    """Task function: (id, text, row, class, numbers) sorted by id to (batch, gram, texts, tfs, head), a row per gram and batch of texts.

    `texts` are the numbers in the batch of the texts that have the gram, 2 bytes each, and `tfs` how often, 4 bytes each. Each batch begins with a row
    without gram whose `head` has (rows, classes, text of each row, numbers, number of texts); rows of one id share a text.
    """
    def run(batches):
        held, task = {}, TaskContext.get().partitionId()

        def seen():
            for b in batches:
                for name, *row in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                    held.setdefault(name, []).append(row)
                yield b

        for k, (ids, counts) in enumerate(_counted(seen(), n_min, n_max, chunk, MOST)):
            members = [held.pop(name) for name in ids]
            rows, classes, numbers = zip(*(row for some in members for row in some))
            head = pickle.dumps((np.array(rows, np.int64), np.array(classes, np.int32), np.repeat(np.arange(len(ids)), [len(x) for x in members]),
                                 np.array(numbers, np.float64), len(ids)))
            batch = task << 32 | k
            yield pa.RecordBatch.from_arrays([pa.array([batch]), pa.array([None], pa.string()), pa.array([None], pa.binary()), pa.array([None], pa.binary()),
                                              pa.array([head], pa.binary())], ["batch", "gram", "texts", "tfs", "head"])
            for names, which, text, tf in counts:
                starts = np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(which))
                cells = [pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((starts * x.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())])
                         for x in (text.astype(np.uint16), tf.astype(np.uint32))]
                yield from _batches([pa.array(np.full(len(names), batch)), names, *cells, pa.nulls(len(names), pa.binary())], ["batch", "gram", "texts", "tfs", "head"])
    return run
