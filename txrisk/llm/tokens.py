"""Token ids of whole texts, encoded piece by piece with a bounded cache.

Vocabularies with a pre-tokenizer split a text before merging, and no split ever
spans a single white-space character between two other characters. Texts without runs of white
space are therefore cut at blanks and line ends, every distinct piece is
encoded once per worker, and the ids of a text are the ids of its pieces. All
other texts are encoded whole. Either way the ids equal those of the whole text.

Vocabularies that drop white space and capitals lower-case before they split, and split marks
from letters and numbers. Texts of Latin-1 characters are lower-cased before they are cut there, and
marks are pieces of their own, so a word is encoded once, however it is written and
whatever stands around it.

Added tokens written out in a text, such as ``<|endoftext|>``, get their own ids, as in the
library's plain encode. They hold no white space, so no cut falls into one.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from operator import attrgetter

#: White space that may not be cut: a run, or anything but a blank or a line end.
_RUNS = re.compile("[\\s᠎](?:[\\s᠎]|(?<![ \\n]))")
#: The same for ASCII texts: neighbours, and single characters.
_DOUBLE = ("  ", " \n", "\n ", "\n\n")
_OTHER = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
#: ASCII marks, which are neither letters nor numbers nor white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What byte-level vocabularies show for each byte: itself if it is a visible
#: Latin-1 character, else the next character from U+0100 on.
_VISIBLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_HIDDEN = sorted(set(range(256)) - set(_VISIBLE))
_SHOWN = "".join(chr(b if b in _VISIBLE else 256 + _HIDDEN.index(b)) for b in range(256))

#: Latin-1 in lower case with blanks for all white space, and what of it is no mark.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
_LOWER = "".join(" " if c in _SPACES else c.lower() for c in map(chr, range(256))).encode("latin-1")
_UNMARKED = bytes(b for b in range(256) if b == 32 or chr(b).isalnum())
_APOSTROPHE = ord("'")

_ID = attrgetter("id")

_ENCODERS: dict[tuple[str, bool, int], "Encoder"] = {}


def encoder(path: str, drops_space: bool, limit: int) -> "Encoder":
    """The encoder of a vocabulary file, one per worker process, which keeps it with its pieces."""
    key = (path, drops_space, limit)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, drops_space, limit)
    return _ENCODERS[key]


def _plain_spaces(text: str) -> bool:
    """Whether white space is single blanks and line ends only, as far as a quick look tells."""
    if not text.isascii():
        return not _RUNS.search(text)
    return not any(x in text for x in _DOUBLE) and not any(c in text for c in _OTHER)


def _parts(low: bytes) -> list[bytes]:
    """Runs of marks, and of letters and numbers, of a text that ``_LOWER`` has been through.

    An apostrophe may take letters along, so it stays with those beside it; where it
    stands beside other marks, the text is cut at white space only.
    """
    marks, apart = set(low.translate(None, _UNMARKED)), low
    for mark in marks - {_APOSTROPHE}:
        apart = apart.replace(b"%c" % mark, b"\t%c\n" % mark)
    if _APOSTROPHE in marks and (b"\n'" in apart or b"'\t" in apart):
        return low.split()
    return apart.replace(b"\n\t", b"").split()


class Encoder(dict):
    """``ids(texts)``: little-endian unsigned 32-bit ids as bytes, one value a text.

    ``drops_space`` says that the vocabulary removes white space and capitals, and splits
    letters, numbers and runs of other marks, ``'`` and letters behind it aside.
    The object is itself the cache from pieces to ids, in two generations of ``limit``
    pieces: a full one becomes the older one, and what is met again comes back from it.
    Pieces over ``longest`` are not kept.
    """

    def __init__(self, path: str, drops_space: bool, limit: int = 200_000, longest: int = 64):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        self.limit, self.longest = limit, longest
        self.older: dict[str | bytes, bytes] = {}
        self.tails: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode("latin-1", "replace").translate(_LOWER) for t in added]
        self.merges = self.tokenizer.model.tokenize
        self.tokenizer.model._resize_cache(0)  # this object is the cache
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(self.longest * 4)]
        self.line = b"" if drops_space else self.whole("\n")
        self.blank = "" if drops_space else _SHOWN[32]

    def whole(self, text: str) -> bytes:
        (coded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return array("I", coded.ids).tobytes()

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        skip, known = len(self.line), self.__getitem__
        for text in texts:
            pieces = self._pieces(text)
            if pieces is None:
                yield self.whole(text)
                continue
            yield b"".join(map(known, pieces))[skip:]
            if len(self) > self.limit:
                self.older = dict(self)
                self.clear()

    def _pieces(self, text: str) -> list | None:
        """What ``text`` is cut into, bytes of Latin-1 in lower case or plain; None if it may not be cut."""
        if self.drops_space:
            try:
                low = text.encode("latin-1").translate(_LOWER)
            except UnicodeEncodeError:
                pass
            else:
                # An added token counts as written, and its marks are not apart.
                return None if any(t in low for t in self.added) else _parts(low)
        if not _plain_spaces(text):
            return None
        # A piece after a line end keeps it; only the first has neither sign.
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\n" + pieces[0]
        return pieces

    def __missing__(self, piece: str | bytes) -> bytes:
        """Ids of a piece that follows a blank, or a line end if it begins with one."""
        coded = self.older.get(piece)
        if coded is None:
            coded = self._coded(piece) if isinstance(piece, str) else self._lower(piece.decode("latin-1"))
        if len(piece) <= self.longest:
            self[piece] = coded
        return coded

    def _lower(self, word: str) -> bytes:
        """Ids of a piece of Latin-1 in lower case, where blanks are dropped."""
        if len(word) > self.longest or not word.isalpha():
            return self._coded(word)
        return self._merged("", word)

    def _merged(self, blank: str, letters: str) -> bytes:
        """Ids of a blank, as shown, and letters that are one piece with it."""
        if not letters.isascii():
            letters, _ = charmap_decode(letters.encode(), "strict", _SHOWN)
        got = self.merges(blank + letters)
        return self.pack[len(got)](*map(_ID, got))

    def _coded(self, piece: str) -> bytes:
        begins = piece[:1] == "\n"
        word = piece[1:] if begins else piece
        head, end = word, b""
        letters_only = word.isalpha()
        if not letters_only:
            # Marks behind letters are a piece of their own, all of them together.
            head = word.rstrip(_MARKS)
            if head and head is not word:
                end = self.tails.get(word[len(head) :])
                if end is None:
                    end = self._tail(word[len(head) :])
                letters_only = head.isalpha()
        if not (letters_only and len(head) <= self.longest and (head.isascii() or max(head) < "Ā")):
            # Not plain letters: the vocabulary's own splits are needed.
            return self.whole(piece if begins or self.drops_space else " " + piece)
        if end and not begins:
            known = self.get(head)
            if known is not None:
                return known + end
        # Plain letters are one piece, so the merges can run on them at once.
        coded = self._merged("" if begins else self.blank, head.lower() if self.drops_space else head)
        if begins:
            return self.line + coded + end
        if end:
            # The same letters may come without marks, or with others.
            self[head] = coded
        return coded + end

    def _tail(self, marks: str) -> bytes:
        """Ids of marks behind letters."""
        coded = self.whole("a" + marks)[len(self.whole("a")) :]
        if len(marks) <= 16 and len(self.tails) < 100_000:
            self.tails[marks] = coded
        return coded
