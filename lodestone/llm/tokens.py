"""What the encoders share: cutting a text where the byte-level pre-tokenizer always cuts, and encoding the pieces."""

import re
import sys
import types

from tokenizers import Tokenizer

# A space belongs to the visible character after it, so a text can be cut before any such space. Where white space follows
# the space, or the text ends, there is no such cut.
UNSAFE = re.compile(r" (?=\s|$)")


def cut(text: str) -> list[str]:
    """Pieces whose encodings, put together, are the encoding of the text."""
    if not text:
        return []
    parts = text.split(" ")
    if not UNSAFE.search(text):
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out if out[0] else out[1:]


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the worker process, whichever task asks for it."""
    module = sys.modules.setdefault("_lodestone_worker", types.ModuleType("_lodestone_worker"))
    return module.__dict__.setdefault(name, {})


def tokenizer(blob: str) -> Tokenizer:
    """The tokenizer of a JSON text, once for each worker."""
    held = worker_store("tokenizers")
    if blob not in held:
        held.clear()
        held[blob] = Tokenizer.from_str(blob)
        held[blob].no_truncation()
        held[blob].no_padding()
    return held[blob]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_blob(path: str | None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()
