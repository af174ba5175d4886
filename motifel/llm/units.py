"""Ids of short texts by a BPE file of the tokenizers library, fast and remembered.

``Bpe`` gives the ids that the library gives. Where a text is plain (no special tokens, Latin
letters, printable) it is normalised and cut here as the file says, and each piece is merged by
tiktoken over the same vocabulary, which is several times faster for single words. Both merge
the pair of lowest rank first, and ranks are ids as long as the file lists merges in the order
of ids; that is checked, and any other text or file goes through the library itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable

import regex

#: The end of a word, as a byte that UTF-8 never has.
_END = b"\xff"
_LAST = "ɐ"
"""Below it there are no combining marks and no letters whose lower case depends on others."""


def _byte_of() -> dict[str, int]:
    """The sign that stands for each byte in such files: printable bytes for themselves, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Bpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.core, self.pattern, self.end, self.lower = None, None, b"", False
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added: list[str] = self._added(spec.get("added_tokens") or [])
        self._prepare(spec)

    @staticmethod
    def _added(tokens: list[dict]) -> list[str]:
        """Tokens that the library takes out of a text before anything else, longest first."""
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
            raise ValueError("added tokens that look at their neighbours are not supported")
        return sorted((t["content"] for t in tokens), key=len, reverse=True)

    def _prepare(self, spec: dict) -> None:
        """Sets up the fast way for the two forms of files that it knows."""
        import tiktoken

        model, vocab, suffix = spec["model"], spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [vocab[m] for m in merged]
        if model["type"] != "BPE" or order != sorted(order) or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            return
        steps = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])
        cuts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        kinds = [s["type"] for s in steps], [c["type"] for c in cuts]
        if kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and cuts[0]["invert"] and not cuts[1]["use_regex"] and suffix:
            self.pattern, self.lower = regex.compile(cuts[0]["pattern"]["Regex"]), True
        elif kinds == ([], ["ByteLevel"]) and cuts[0]["use_regex"] and not cuts[0]["add_prefix_space"] and not suffix:
            #: Fixed value: the pattern of byte-level pre-tokenizers.
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        else:
            return
        byte, ranks = _byte_of(), {}
        for token, i in vocab.items():
            last = bool(suffix) and token.endswith(suffix)
            signs = token[: -len(suffix)] if last else token
            if all(c in byte for c in signs):
                key = bytes(byte[c] for c in signs)
                if _END not in key:
                    ranks[key + _END if last else key] = i
        ranks.setdefault(_END, max(vocab.values()) + 1)
        self.end = _END if suffix else b""
        self.core = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __call__(self, text: str) -> list[int]:
        core = self.core
        if core is None or "<|" in text or not text.isprintable() or not (text.isascii() or max(text) < _LAST):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if self.lower:
            text = text.lower()
        if text.isalpha():
            return core.encode_single_piece(text.encode() + self.end)
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += core.encode_single_piece(piece.encode() + self.end)
        return ids


class Memory:
    """key -> what ``value`` makes of the ids of its text. Holds at most ``most`` keys besides those of the last request."""

    def __init__(self, path: str, text: Callable, value: Callable, most: int):
        self.bpe, self.text, self.value, self.most = Bpe(path), text, value, most
        self.known: dict = {}

    def learn(self, keys: Iterable) -> None:
        keys = set(keys)
        known, text, value, bpe = self.known, self.text, self.value, self.bpe
        for k in keys.difference(known):
            known[k] = value(bpe(text(k)))
        if len(known) > self.most:
            self.known = {k: known[k] for k in keys}
