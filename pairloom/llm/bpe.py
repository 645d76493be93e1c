"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A sequence of tokens is what the merges would
give exactly if no merge across a token boundary could come before the merges inside its two
neighbours, so it is enough to test each adjacent pair; all distinct pairs of a batch are tested
at once with array operations over the left and right edges of the tokens' merge trees. Only the
words in which a pair fails are merged one step at a time.

Texts are cut at white space first. A piece between spaces always gives the same tokens, so a
worker keeps the pieces and words it has seen lately (about `CACHE_PIECES` and `CACHE_WORDS`; this
bounds memory and changes no result). The job is one map over the rows: no shuffle, one batch in memory.

The tokenizer file is JSON of the kind: NFC and lower case, white space dropped, word pattern,
byte letters, end-of-word mark, special tokens found in the raw text. Letters that Unicode gained
after version 15 can be classed otherwise than by another library with older tables.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from itertools import chain

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.rows import map_batches, texts_of

CACHE_PIECES = 150_000
CACHE_WORDS = 240_000
GROUP_CHARS = 2 << 20
LONG_WORD = 256
NEVER = 1 << 30


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent:
    """Entries (ids, text) in two generations; the older one goes when the younger is full.

    What a group asks for is moved to the younger generation, so frequent entries stay.
    """

    def __init__(self, most: int):
        self.most = most // 2
        self.young: tuple[dict[str, bytes], dict[str, str]] = ({}, {})
        self.old: tuple[dict[str, bytes], dict[str, str]] = ({}, {})

    def missing(self, need: set[str]) -> set[str]:
        lack = need.difference(self.young[0])
        back = lack.intersection(self.old[0])
        for now, before in zip(self.young, self.old):
            now.update(zip(back, map(before.__getitem__, back)))
        return lack - back

    def add(self, key: str, ids: bytes, text: str) -> None:
        self.young[0][key], self.young[1][key] = ids, text

    def age(self) -> None:
        if len(self.young[0]) > self.most:
            self.old, self.young = self.young, ({}, {})


# Where the character tables of the tokenizer differ from those of `regex` and of `str.lower`.
#: letters and digits of `regex` that are neither to the tokenizer (its patterns are at Unicode 16), as (first, last)
NO_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: capitals that the tokenizer lowers (at Unicode 17) and older tables don't, as (first, last, lower form of the first)
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: a character that no version assigns
UNASSIGNED = "\U000effff"


def _one_of(spans: tuple) -> regex.Pattern:
    return regex.compile("[" + "".join(f"{chr(s[0])}-{chr(s[1])}" for s in spans) + "]")


_NO_LETTER, _CAPITAL = _one_of(NO_LETTERS), _one_of(CAPITALS)
_LOWER = {c: low + c - first for first, last, low in CAPITALS for c in range(first, last + 1)}


class WordBpe:
    """Tables of one tokenizer and the pieces encoded so far."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        self.mark = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.names = {i: s for s, i in chain(self.ids.items(), self.special.items())}
        splits = [p for p in parsed["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = _byte_letters()
        self._merge_tables([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.seen, self.seen_words = Recent(CACHE_PIECES), Recent(CACHE_WORDS)

    def _merge_tables(self, merges: list[tuple[str, str]]) -> None:
        size = max(self.names) + 1
        left, right = np.full(size, -1), np.full(size, -1)
        rank_of = np.full(size, -1)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks, products = [], [], []
        for r, (a, b) in enumerate(merges):
            x, y, made = self.ids[a], self.ids[b], self.ids[a + b]
            if (x, y) in self.rank:
                continue
            self.rank[x, y] = (r, made)
            keys.append(x * size + y)
            ranks.append(r)
            products.append(made)
            if rank_of[made] < 0:
                left[made], right[made], rank_of[made] = x, y, r
        order = np.argsort(keys)
        self.size = size
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.key_ranks = np.array(ranks, dtype=np.int64)[order]
        self.key_made = np.array(products, dtype=np.int64)[order]
        self.right_edge, self.right_until = self._edges(right, rank_of)
        self.left_edge, self.left_until = self._edges(left, rank_of)
        # a token that its own letters would not be merged to must never be proposed
        self.proposed: dict[str, int] = {}
        self.longest = 1
        for token, i in self.ids.items():
            if rank_of[i] < 0 or self._merged(self._letters_of(token)) == [i]:
                self.proposed[token] = i
                self.longest = max(self.longest, len(token.removesuffix(self.mark)))
        self._trie_tables()

    def _trie_tables(self) -> None:
        """A trie of the proposable tokens over bytes: sorted child keys and the tokens at nodes."""
        byte_of = {c: b for b, c in self.letters.items()}
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[tuple[int, bool], int] = {}
        for token, i in self.proposed.items():
            body, at = token.removesuffix(self.mark) or token, 0
            for c in body:
                at = nodes.setdefault((at, byte_of[c]), len(nodes) + 1)
            ends[at, body != token] = i
        self.trie_keys = np.array(sorted(a << 8 | b for a, b in nodes), dtype=np.int64)
        self.trie_next = np.array([nodes[k >> 8, k & 255] for k in self.trie_keys.tolist()], dtype=np.int64)
        self.inner, self.final = (np.full(len(nodes) + 1, -1) for _ in range(2))
        for (at, marked), i in ends.items():
            (self.final if marked else self.inner)[at] = i
        letter = [self.ids[self.letters[b]] for b in range(256)]
        self.byte_id = np.array(letter)
        self.last_byte_id = np.array([self.ids[self.letters[b] + self.mark] for b in range(256)])

    @staticmethod
    def _edges(child: np.ndarray, rank_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes on one edge of each token's merge tree, and the rank of the merge that ends each."""
        nodes, until = [np.arange(len(child))], [np.full(len(child), NEVER)]
        while True:
            last = nodes[-1]
            below = np.where(last >= 0, child[last], -1)
            if not (below >= 0).any():
                return np.stack(nodes, axis=1), np.stack(until, axis=1)
            nodes.append(below)
            until.append(np.where(below >= 0, rank_of[last], -1))

    def _letters_of(self, word: str) -> list[int]:
        """Ids of the single letters of a token or word, the mark on the last one."""
        body = word.removesuffix(self.mark)
        ids = [self.ids[c] for c in body[:-1]]
        return [*ids, self.ids[body[-1] + self.mark * (body != word)]]

    def _merged(self, tokens: list[int]) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first."""
        while len(tokens) > 1:
            best, at = (NEVER, -1), -1
            for k in range(len(tokens) - 1):
                found = self.rank.get((tokens[k], tokens[k + 1]))
                if found and found[0] < best[0]:
                    best, at = found, k
            if at < 0:
                break
            tokens[at : at + 2] = [best[1]]
        return tokens

    def _merged_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list, for words of many letters."""
        import heapq

        n = len(tokens)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(f[0], k, f[1], tokens[k], tokens[k + 1]) for k in range(n - 1) if (f := self.rank.get((tokens[k], tokens[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, made, x, y = heapq.heappop(heap)
            m = after[k]
            if tokens[k] != x or m < 0 or tokens[m] != y:
                continue
            tokens[k], tokens[m] = made, -1
            after[k] = after[m]
            if after[m] >= 0:
                before[after[m]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (f := self.rank.get((tokens[a], tokens[b]))):
                    heapq.heappush(heap, (f[0], a, f[1], tokens[a], tokens[b]))
        return [t for t in tokens if t >= 0]

    def _proposal(self, word: str) -> list[int]:
        """Greedy longest match over the letters of a marked word."""
        body, mark, known = word, self.mark, self.proposed
        out, i, n = [], 0, len(body)
        while i < n:
            if n - i <= self.longest and (t := known.get(body[i:] + mark)) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + self.longest), i, -1):
                if (t := known.get(body[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:  # only the last letter is left, and it is always known with the mark
                out.append(self.ids[body[i:] + mark])
                break
        return out

    def _conflicts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where some merge across the boundary of (a, b) could precede those inside."""
        bad = np.zeros(len(a), dtype=bool)
        for i in range(self.right_edge.shape[1]):
            x = self.right_edge[a, i]
            if not (x >= 0).any():
                break
            for j in range(self.left_edge.shape[1]):
                y = self.left_edge[b, j]
                live = np.flatnonzero((x >= 0) & (y >= 0) & ~bad)
                if not len(live):
                    break
                key = x[live] * self.size + y[live]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ends = np.minimum(self.right_until[a[live], i], self.left_until[b[live], j])
                bad[live] = (self.keys[at] == key) & (self.key_ranks[at] <= ends)
        return bad

    def _proposals(self, flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: (tokens, owner) in the order of the words.

        `flat` holds the bytes of the words, word w from start[w] to stop[w].
        """
        words, at = np.arange(len(start)), start.copy()
        owners, tokens, places = [], [], []
        while len(words):
            node, deep = np.zeros(len(words), dtype=np.int64), at[words].copy()
            best, best_end = np.full(len(words), -1), np.zeros(len(words), dtype=np.int64)
            live = np.arange(len(words))
            end = stop[words]
            while len(live):
                key = node[live] << 8 | flat[deep[live]]
                k = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
                hit = self.trie_keys[k] == key
                live, k = live[hit], k[hit]
                node[live] = self.trie_next[k]
                deep[live] += 1
                last = deep[live] == end[live]
                found = np.where(last, self.final[node[live]], self.inner[node[live]])
                good = found >= 0
                best[live[good]], best_end[live[good]] = found[good], deep[live[good]]
                live = live[~last]
            owners.append(words)
            tokens.append(best)
            places.append(at[words])
            at[words] = best_end
            words = words[best_end < end]
        owner, token, place = (np.concatenate(x) for x in (owners, tokens, places))
        order = np.argsort(place)
        return token[order], owner[order]

    def _merged_words(self, flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words side by side: each round does the next merge of every word."""
        sizes = stop - start
        owner = np.repeat(np.arange(len(start)), sizes)
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = flat[np.repeat(start, sizes) + inner]
        symbol = np.where(inner == sizes[owner] - 1, self.last_byte_id[letters], self.byte_id[letters])
        done_symbols, done_owners = [], []
        while len(symbol):
            rank, made = np.full(len(symbol), NEVER), np.zeros(len(symbol), dtype=np.int64)
            at = np.flatnonzero(owner[1:] == owner[:-1])
            key = symbol[at] * self.size + symbol[at + 1]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            rank[at[hit]], made[at[hit]] = self.key_ranks[k[hit]], self.key_made[k[hit]]
            cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, cuts), np.diff(np.append(cuts, len(owner))))
            stay = lowest < NEVER
            done_symbols.append(symbol[~stay])
            done_owners.append(owner[~stay])
            best = np.flatnonzero(stay & (rank == lowest))
            best = best[np.concatenate([[True], owner[best][1:] != owner[best][:-1]])] if len(best) else best
            symbol[best] = made[best]
            stay[best + 1] = False
            symbol, owner = symbol[stay], owner[stay]
        symbol, owner = np.concatenate(done_symbols), np.concatenate(done_owners)
        order = np.argsort(owner, kind="stable")
        return symbol[order], owner[order]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Tokens of words given as UTF-8 bytes."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        stop = np.cumsum(sizes)
        start = stop - sizes
        short = np.flatnonzero(sizes <= LONG_WORD)
        token, owner = self._proposals(flat, start[short], stop[short])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(token[inside] * self.size + token[inside + 1], return_inverse=True)
        bad = self._conflicts(pairs // self.size, pairs % self.size)
        failed = np.unique(owner[inside[bad[where]]])
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        token = token.astype("<u4")
        _deal(out, short, token, owner)
        if len(failed):
            again = short[failed]
            token, owner = self._merged_words(flat, start[again], stop[again])
            _deal(out, again, token.astype("<u4"), owner)
        for w in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[w] = np.array(self._long_word("".join(map(self.letters.__getitem__, words[w]))), dtype="<u4")
        return out

    def _long_word(self, letters: str) -> list[int]:
        """The same for one very long word: propose, test its pairs, merge with a heap if one fails."""
        proposal = np.array(self._proposal(letters))
        if self._conflicts(proposal[:-1], proposal[1:]).any():
            return self._merged_long(self._letters_of(letters + self.mark))
        return proposal.tolist()

    def _parts(self, piece: str) -> list[str | int]:
        """Words, and ids of special tokens, of a piece without white space."""
        low = self._lowered(piece)  # lowering can split letters into letters and marks
        if low.isalpha():
            return [low]
        if low[:-1].isalpha() and low[-1] in ".,":
            return [low[:-1], low[-1]]
        out: list[str | int] = []
        for k, raw in enumerate(self.specials.split(piece) if "<" in piece else [piece]):
            if k % 2:
                out.append(self.special[raw])
            elif raw:
                out += self._split(self._lowered(raw))
        return out

    def _split(self, text: str) -> list[str]:
        """The words of a text; characters that its tables don't know are no letters or digits to the tokenizer."""
        if text.isascii() or not _NO_LETTER.search(text):
            return self.words.findall(text)
        return [text[m.start() : m.end()] for m in self.words.finditer(_NO_LETTER.sub(UNASSIGNED, text))]

    @staticmethod
    def _lowered(raw: str) -> str:
        if raw.isascii():
            return raw.lower()
        # each letter is lowered by itself, a final sigma too
        low = unicodedata.normalize("NFC", raw).replace("Σ", "σ").lower()
        return low.translate(_LOWER) if _CAPITAL.search(low) else low

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet, all of a batch together."""
        parts = [self._parts(p) for p in pieces]
        words = list(self.seen_words.missing({w for ps in parts for w in ps if isinstance(w, str)}))
        if words:
            for w, ids in zip(words, self.encode_words([x.encode() for x in words])):
                self.seen_words.add(w, ids.tobytes(), self.decode(ids.tolist()))
        ids_of, text_of = self.seen_words.young
        for piece, ps in zip(pieces, parts):
            if len(ps) == 1 and isinstance(ps[0], str):
                self.seen.add(piece, ids_of[ps[0]], text_of[ps[0]])
            else:
                made = [(ids_of[p], text_of[p]) if isinstance(p, str) else (p.to_bytes(4, "little"), self.names[p]) for p in ps]
                self.seen.add(piece, b"".join([m[0] for m in made]), " ".join([m[1] for m in made]))
        self.seen_words.age()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: such a file names no decoder."""
        return " ".join([self.names[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        """White space here does not include the four separators that Python counts as such."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [p for p in regex.split(r"\s+", text) if p]
        return text.split()

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian 32-bit integers and the decoded text, per text."""
        out, start, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= GROUP_CHARS or k == len(texts) - 1:
                out += self._encode_group([self.pieces(x) for x in texts[start : k + 1]])
                start, size = k + 1, 0
        return out

    def _encode_group(self, cut: list[list[str]]) -> list[tuple[bytes, str]]:
        """Learn what the texts of a group need in one go, then join the parts of each text."""
        need = set().union(*cut)
        missing = self.seen.missing(need)
        if missing:
            self.learn(list(missing))
        ids, names = self.seen.young[0].__getitem__, self.seen.young[1].__getitem__
        made = [(b"".join(map(ids, c)), " ".join(map(names, c))) for c in cut]
        self.seen.age()
        return made


def _deal(out: list, words: np.ndarray, token: np.ndarray, owner: np.ndarray) -> None:
    """Give each word its run of tokens; `owner` counts the words from 0 in order."""
    cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
    for k, w in enumerate(words.tolist()):
        out[w] = token[cuts[k] : cuts[k + 1]]


_LOADED: dict[str, WordBpe] = {}


def _loaded(spec: Broadcast) -> WordBpe:
    key = hashlib.md5(spec.value.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec.value)
    return _LOADED[key]


def read_spec(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file (a few MB, whatever the input) as a broadcast; read by the driver only."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def bpe(
    df: DataFrame, tokenizer: str, text: str = "text", digests_only: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """Adds `n_tokens`, `token_ids` and `decoded` to the columns `keep` (default: all) of `df`.

    `tokenizer` is the path of the tokenizer file on the driver. With `digests_only` the ids and
    the decoded text are left out in favour of `ids_sha256` and `decoded_sha256`, as for a check of
    a whole corpus. A null or empty or blank text has no tokens and decodes to the empty text;
    special tokens in a text keep their own ids; repeated rows repeat their result; an empty table
    gives an empty table. An input column with the name of an added one is replaced.
    """
    spec = read_spec(df.sparkSession, tokenizer)
    added = ["ids_sha256", "decoded_sha256"] if digests_only else ["token_ids", "decoded"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("n_tokens", *added)]
    source = df.select(*dict.fromkeys([*keep, text]))
    kinds = "string, decoded_sha256 string" if digests_only else "array<int>, decoded string"

    def work(batch):
        gc.disable()  # the caches hold no cycles; scanning them again and again is most of the time
        made = _loaded(spec).encode_batch(texts_of(batch, text))
        n = [len(ids) // 4 for ids, _ in made]
        if digests_only:
            values = [
                [hashlib.sha256(ids).hexdigest() for ids, _ in made],
                [hashlib.sha256(t.encode()).hexdigest() for _, t in made],
            ]
        else:
            import pyarrow as pa

            ids = np.frombuffer(b"".join(i for i, _ in made), dtype="<u4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            values = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array([t for _, t in made], pa.string())]
        return {"n_tokens": np.array(n, dtype=np.int64), **dict(zip(added, map(_strings, values)))}

    return map_batches(source, work, f"n_tokens bigint, {added[0]} {kinds}", keep)


def _strings(values):
    import pyarrow as pa

    return pa.array(values, pa.string()) if isinstance(values, list) else values
