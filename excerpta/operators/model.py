"""Content-type model: features, thresholds and labels; inference where a model file is given."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, SIDE, PAD, LEAST = 4096, 1024, 256, 8
_SPACE = b" \t\n\r\x0b\x0c"
# File type of each content label that has one of its own.
TYPE_OF_LABEL = {
    "doc": "doc", "docx": "docx", "xls": "xls", "xlsx": "xlsx", "ppt": "ppt", "pptx": "pptx", "pdf": "pdf", "txt": "txt", "zip": "zip", "7z": "7z", "rar": "rar", "tar": "tar", "gz": "gz",
    "png": "png", "jpg": "jpg", "jpeg": "jpg", "bmp": "bmp", "gif": "gif", "webp": "webp", "html": "html", "xml": "xml", "json": "json", "textproto": "txt", "empty": "empty", "unknown": "unknown",
    "mid": "mid", "midi": "mid", "wav": "wav", "ogg": "ogg", "mp3": "mp3", "8svx": "8svx", "aac": "aac", "ac3": "ac3", "aiff": "aiff", "amb": "amb", "amr": "amr", "au": "au", "avr": "avr", "caf": "caf", "cdda": "cdda",
    "cvs": "cvs", "cvu": "cvu", "dts": "dts", "dvms": "dvms", "fap": "fap", "flac": "flac", "fssd": "fssd", "gsrt": "gsrt", "hcom": "hcom", "htk": "htk", "ima": "ima", "ircam": "ircam", "m4a": "m4a", "m4r": "m4r",
    "maud": "maud", "mmf": "mmf", "mp2": "mp2", "nist": "nist", "oga": "oga", "opus": "opus", "paf": "paf", "pcma": "pcma", "pcmu": "pcmu", "prc": "prc", "pvf": "pvf", "ra": "ra", "sd2": "sd2", "sln": "sln", "smp": "smp",
    "snd": "snd", "sndr": "sndr", "sndt": "sndt", "sou": "sou", "sph": "sph", "spx": "spx", "tta": "tta", "txw": "txw", "vms": "vms", "voc": "voc", "vox": "vox", "w64": "w64", "wma": "wma", "wv": "wv", "wve": "wve",
}


def features(raw: bytes) -> list[int]:
    """1024 bytes from the first block after leading blanks, 1024 to the last block's end before trailing ones; 256 fills up."""
    head, tail = raw[:BLOCK].lstrip(_SPACE)[:SIDE], raw[-BLOCK:].rstrip(_SPACE)[-SIDE:]
    return [*head, *[PAD] * (SIDE - len(head)), *[PAD] * (SIDE - len(tail)), *tail]


def features_column(content: Column) -> Column:
    """``features`` as an expression."""
    latin = lambda c: F.decode(c, "ISO-8859-1")
    head = F.substring(F.regexp_replace(latin(F.substring(content, 1, BLOCK)), "^[ \t\n\r\x0b\x0c]+", ""), 1, SIDE)
    end = F.regexp_replace(latin(F.when(F.length(content) > BLOCK, F.substring(content, -BLOCK, BLOCK)).otherwise(content)), "[ \t\n\r\x0b\x0c]+$", "")
    tail = F.when(F.length(end) > SIDE, F.substring(end, -SIDE, SIDE)).otherwise(end)
    codes = lambda s: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
    pad = lambda s: F.array_repeat(F.lit(PAD), SIDE - F.length(s))
    return F.concat(codes(head), pad(head), pad(tail), codes(tail))


def small_label(content: Column) -> Column:
    """Label of contents too short for the model, else null."""
    trimmed = F.regexp_replace(F.decode(F.substring(content, 1, BLOCK), "ISO-8859-1"), "^[ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$", "")
    return F.when(F.length(content) == 0, "empty").when(F.length(trimmed) < LEAST, F.when(F.is_valid_utf8(F.substring(content, 1, BLOCK).cast("string")), "txt").otherwise("unknown"))


def decided(scores: Column, labels: list[str], thresholds: dict[str, float], is_text: dict[str, bool], default: float = 0.5) -> Column:
    """Label of the first greatest score if it reaches its threshold, else ``txt`` or ``unknown`` by whether the label is text."""
    best = F.array_max(scores)
    label = F.get(F.array(*map(F.lit, labels)), (F.array_position(scores, best) - 1).cast("int"))
    look = lambda pairs, kind: F.element_at(F.from_json(F.lit(json.dumps(pairs)), f"map<string,{kind}>"), label)
    need, text = F.coalesce(look(thresholds, "double"), F.lit(default)), F.coalesce(look(is_text, "boolean"), F.lit(False))
    return F.when(best >= need, label).otherwise(F.when(text, "txt").otherwise("unknown"))


@lru_cache(1)
def session(path: str):
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


def scores(path: str, raws: list[bytes]) -> np.ndarray:
    """Scores of a batch by the ONNX model at ``path``."""
    s = session(path)
    return s.run(None, {s.get_inputs()[0].name: np.array([features(r) for r in raws], np.int32)})[0]


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def type_of_label(label: str, extensions: list[str]) -> str:
    """File type of a content type: that of its label, else its first extension, else the label itself."""
    return TYPE_OF_LABEL.get(label) or (extensions[0] if extensions else label)


def label_type(label: Column, extensions: Column) -> Column:
    """``type_of_label`` as an expression; ``extensions`` is an array."""
    own = F.element_at(F.from_json(F.lit(json.dumps(TYPE_OF_LABEL)), "map<string,string>"), label)
    return F.coalesce(own, F.get(extensions, F.lit(0)), label)
