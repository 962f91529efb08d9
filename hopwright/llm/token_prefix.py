"""Exact BPE token counts at every prefix of a text, by dynamic programming.

A byte-level BPE first cuts a text into pieces that never share a token; within a piece the encoding of each prefix
ends in exactly one token that can follow the encoding before it. So one pass over a piece gives, for each of its
byte prefixes, the last token and hence the count: ``count[i] = count[i - len(last)] + 1``. The counts of whole
pieces add up, and the count at any code point of a text follows from the pieces before it and one stored table.

Nulls and empty texts have 0 tokens. A text may be of any length: pieces are independent and only short ones are kept
in the cache of a worker. Repeated rows give repeated results; an empty table gives an empty result; other columns of the input are
not read and may have any names. A prefix may take more tokens than a longer one; where a budget is asked for, the longest prefix
within it counts. Files that ask for other rules than plain byte-level BPE are refused.
"""

from __future__ import annotations

import gc
import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwright.llm.common import table

#: The published split pattern of this family of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refuse_other_rules(spec: dict) -> None:
    """Raises where a file asks for rules that are not followed here, rather than count by others."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    for name, fits in {
        "normalizer": spec.get("normalizer") is None,
        "pre_tokenizer": cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"),
        "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }.items():
        if not fits:
            raise ValueError(f"{name}: only plain byte-level BPE vocabularies are counted here")


class PrefixCounter:
    """Counts for one vocabulary file in the JSON layout of the ``tokenizers`` library."""

    def __init__(self, path: str, cache_pieces: int = 300_000, cache_bytes: int = 64):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_other_rules(spec)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        # Only tokens that the merges themselves produce can occur in an encoding.
        self.tokens = {t: i for t, i in self.vocab.items() if self._merge(t) == [t]}
        self.spelt = {i: t for t, i in self.tokens.items()}
        # Tokens by their bytes from the last to the first; under -1 the token that is complete there.
        self.ends: dict = {}
        for token, i in self.tokens.items():
            node = self.ends
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = i
        self._follows: dict[int, bool] = {}
        self._states: dict[bytes, int] = {}
        self._total: dict[str, int] = {}
        self._older: dict[str, int] = {}
        self.cache_pieces, self.cache_bytes = cache_pieces, cache_bytes

    def _merge(self, piece: bytes) -> list[bytes]:
        """Plain merging by rank, for short strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether token ``right`` can stand after ``left`` in an encoding; kept for later."""
        a, b = self.spelt[left], self.spelt[right]
        known = self._merge(a + b) == [a, b]
        if len(self._follows) > 2_000_000:
            self._follows.clear()
        self._follows[left << 32 | right] = known
        return known

    def _extend(self, piece: bytes, start: int, states: list[int]) -> list[int]:
        """``states`` of the prefixes up to ``start``, carried on to the whole piece. A state is its count << 32 | its last token."""
        ends, known = self.ends, self._follows
        for end in range(start, len(piece)):
            node, found = ends, []
            for i in range(end, -1, -1):
                node = node.get(piece[i])
                if node is None:
                    break
                if -1 in node:
                    found.append(i << 32 | node[-1])
            while found:  # the longest first; exactly one fits
                token = found.pop()
                i, token = token >> 32, token & 0xFFFFFFFF
                if i == 0:
                    break
                fits = known.get((states[i] & 0xFFFFFFFF) << 32 | token)
                if fits if fits is not None else self.follows(states[i] & 0xFFFFFFFF, token):
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
            states.append((states[i] >> 32) + 1 << 32 | token)
        return states

    def prefix_table(self, piece: bytes) -> list[int]:
        """Token counts of the byte prefixes 0 .. len(piece) of one piece."""
        return [s >> 32 for s in self._extend(piece, 0, [0])]

    def _last_count(self, piece: bytes) -> int:
        """The count of a short piece, carried on from the longest prefix of it that an earlier piece has left."""
        kept = self._states
        if len(kept) > self.cache_pieces:
            kept.clear()
        k = len(piece) - 1
        while k and piece[:k] not in kept:
            k -= 1
        states = [0, *(kept[piece[:i]] for i in range(1, k + 1))]
        self._extend(piece, k, states)
        for i in range(k + 1, len(piece)):
            kept[piece[:i]] = states[i]
        return states[-1] >> 32

    def piece_count(self, piece: str) -> int:
        total = self._older.get(piece)
        if total is None:
            raw = piece.encode()
            if raw in self.tokens:
                total = 1
            elif len(raw) > self.cache_bytes:
                return self.prefix_table(raw)[-1]
            else:
                total = self._last_count(raw)
        if len(self._total) >= self.cache_pieces:  # what is in use moves over from the older half
            self._older = self._total.copy()
            self._total.clear()
        self._total[piece] = total
        return total

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at the strings of special tokens; whether each part is one."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            yield text, False
            return
        for i, part in enumerate(self.special_pattern.split(text)):
            if part:
                yield part, i % 2 == 1

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        known, total = self._total, 0
        for part, special in self.segments(text):
            if special:
                total += 1
                continue
            for piece in self.split.findall(part):
                n = known.get(piece)
                total += self.piece_count(piece) if n is None else n
        return total

    def count_and_cut(self, text: str | None, budget: int) -> tuple[int, int]:
        """Tokens of the whole text, and the largest k for which ``text[:k]`` takes at most ``budget`` tokens. Counts at the ends of
        pieces never fall, so only prefixes that end in the piece that passes the budget are looked up in its table."""
        text = text or ""
        if self.special_pattern is not None and any(s in text for s in self.special):
            total = self.count(text)
            return total, len(text) if total <= budget else self.longest_within(text, budget)
        known, pieces = self._total, self.split.findall(text)
        counts = [known.get(p) or self.piece_count(p) for p in pieces]
        total = sum(counts)
        if total <= budget:
            return total, len(text)
        ends = list(accumulate(counts))
        last = bisect_right(ends, budget)
        # From a piece that no white space stands before: what is cut later can't change the pieces up to there.
        first = max(0, last - 1)
        while first and pieces[first - 1][-1].isspace():
            first -= 1
        base, at = ends[first - 1] if first else 0, sum(map(len, pieces[:first]))
        near = self.at_prefixes("".join(pieces[first : last + 2]))
        return total, at + max((k for k, n in enumerate(near) if base + n <= budget), default=0)

    def at_prefixes(self, text: str | None) -> list[int]:
        """Token counts of ``text[:k]`` for k = 0 .. len(text), each as if that prefix had been encoded on its own."""
        out, base = [0], 0
        for part, special in self.segments(text or ""):
            if special:
                # Until its last character the string is ordinary text, which can join what stands before it.
                tail = text[: len(out) - 1]
                cut = max((tail.rfind(s) + len(s) for s in self.special if s in tail), default=0)
                fixed, open_part = self.count(tail[:cut]), tail[cut:]
                out += [fixed + sum(map(self.piece_count, self.split.findall(open_part + part[:k]))) for k in range(1, len(part))]
                base += 1
                out.append(base)
                continue
            for match in self.split.finditer(part):
                piece = match.group()
                if piece in CONTRACTIONS:
                    # A cut contraction is an apostrophe, then letters.
                    inner = [sum(map(self.piece_count, self.split.findall(piece[:k]))) for k in range(1, len(piece))]
                    out += [base + n for n in inner]
                    base += self.piece_count(piece)
                    out.append(base)
                    continue
                raw = self.prefix_table(piece.encode())
                if len(raw) == len(piece) + 1:
                    out += [base + n for n in raw[1:]]
                else:
                    place = 0
                    for c in piece:
                        place += len(c.encode())
                        out.append(base + raw[place])
                base += raw[-1]
            self._mend_spaces(part, out, len(out) - 1 - len(part))
        return out

    def _mend_spaces(self, part: str, out: list[int], at: int) -> None:
        """Prefixes that end inside a run of white space: the whole run so far is one piece."""
        for run in regex.finditer(r"\s+", part):
            table = self.prefix_table(run.group().encode())
            place = 0
            for k, c in enumerate(run.group(), 1):
                place += len(c.encode())
                out[at + run.start() + k] = out[at + run.start()] + table[place]

    def longest_within(self, text: str, budget: int, prefixes: list[int] | None = None) -> int:
        """The largest k for which ``text[:k]`` takes at most ``budget`` tokens, from the stored counts."""
        prefixes = self.at_prefixes(text) if prefixes is None else prefixes
        if all(a <= b for a, b in zip(prefixes, prefixes[1:])):
            return bisect_right(prefixes, budget) - 1
        return max(k for k, n in enumerate(prefixes) if n <= budget)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    made = PrefixCounter(path)
    gc.freeze()  # the vocabulary stays; the collector need not walk it again and again
    return made


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit and cut_chars, the length in code points of the longest prefix of at most ``limit``
    tokens, for each row; one narrow pass, nothing is shuffled."""
    field = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            n_bytes, found = [], []
            for value in batch.column(1):
                value = value.as_py() or ""
                n_bytes.append(len(value.encode()))
                found.append(tokens.count_and_cut(value, limit))
            n_tokens = [n for n, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array([k for _, k in found], pa.int64())],
                names=[key, "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    kind = field.dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
