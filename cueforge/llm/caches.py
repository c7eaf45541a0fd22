"""A bounded memory of what words give."""

_LONG = 64  # bytes (or characters) of words that are kept


class Remembered(dict):
    """word -> made(word). Words of 64 characters at most are kept until `most` bytes are used; then the memory starts anew."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.used = most, 0

    def made(self, word):
        raise NotImplementedError

    def __missing__(self, word):
        found = self.made(word)
        self.keep(word, found)
        return found

    def keep(self, word, found) -> None:
        if len(word) <= _LONG:
            if self.used > self.most:
                self.clear()
                self.used = 0
            self[word] = found
            self.used += 180 + len(word) + (len(found) if isinstance(found, bytes) else 0)  # a dict's place and the heads of two objects
