"""Token counts by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens, and each pre-token into vocabulary tokens so that the sum
of unigram log probabilities is largest.  The best score of a prefix does not depend on
what follows, so the forward pass over a trie of the distinct pre-tokens does the work of
a shared prefix once.  Visiting the trie depth first is the same as taking the pre-tokens
in sorted order and keeping the forward scores of the common prefix, which needs no
trie in memory; counts are stored at the terminals.

A task remembers the counts of ``CACHE`` pre-tokens, so a frequent one is worked out once
per task; nothing is shuffled.  The vocabulary is read on the driver from a file in
rank order; log probabilities follow ``1 / (rank + SHIFT)``, as such files hold none.

Cases: null and empty texts have no tokens; bytes that the vocabulary lacks count as a
token each at the lowest score; ties go to fewer tokens.  Repeated rows are
counted each.  Other columns are ignored.  Very long pre-tokens take time in proportion
to their length, as tokens have a longest length.
"""

import base64
import math
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SHIFT = 2.7
CACHE = 200_000
CHARS = 1_000_000  # text cut into pre-tokens at once


def vocabulary(path=VOCABULARY):
    """``{token bytes: log probability}`` of a rank file, normalised over all of it."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    total = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
    return {t: -math.log(r + SHIFT) - total for t, r in ranks.items()}


def trie_counts(pretokens, scores, longest, lowest):
    """``{pre-token: tokens of its best split}`` of distinct byte strings.

    ``best[i]`` is the forward score of the first ``i`` bytes of the current branch, as
    ``(score, -tokens)``; the entries of a shared prefix are kept from one to the next.
    """
    counts, best, before = {}, [(0.0, 0)], b""
    for word in sorted(pretokens):
        shared = 0
        for x, y in zip(before, word):
            if x != y:
                break
            shared += 1
        del best[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            score, tokens = best[end - 1]
            top = (score + scores.get(word[end - 1 : end], lowest), tokens - 1)
            for start in range(max(0, end - longest), end - 1):
                p = scores.get(word[start:end])
                if p is not None:
                    score, tokens = best[start]
                    option = (score + p, tokens - 1)
                    if option > top:
                        top = option
            best.append(top)
        counts[word] = -best[-1][1]
        before = word
    return counts


def portions(texts, chars=CHARS):
    """Runs of texts of about ``chars`` characters in all; a longer text is a run of its own."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text or "")
        if held >= chars:
            yield some
            some, held = [], 0
    if some:
        yield some


def token_counts(documents, key="doc_id", text="text", scores=None):
    """``(doc_id, n_pretokens, n_tokens, n_bytes)`` of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(scores or vocabulary())  # of the size of the file

    def counted(batches):
        scores = shared.value
        longest, lowest = max(map(len, scores)), min(scores.values()) - 10.0
        cut = regex.compile(PRETOKEN)
        known = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sums = [[], [], []]
            for some in portions(texts):
                pieces = [Counter(cut.findall(t or "")) for t in some]
                new = set().union(*pieces).difference(known)
                if len(known) + len(new) > CACHE:
                    known = {}
                    new = set().union(*pieces)
                found = trie_counts((p.encode() for p in new), scores, longest, lowest)
                known.update((p, found[p.encode()]) for p in new)
                for t, times in zip(some, pieces):
                    sums[0].append(times.total())
                    sums[1].append(sum(n * known[p] for p, n in times.items()))
                    sums[2].append(len((t or "").encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(s, pa.int64()) for s in sums)], names=["doc_id", "n_pretokens", "n_tokens", "n_bytes"]
            )

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_pretokens long, n_tokens long, n_bytes long")
