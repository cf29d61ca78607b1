"""Decoders and encoders by name: column functions between the data of a packet and its samples.

PCM of 16 bits is integers, as files hold it; all other PCM formats are doubles from -1 to 1.  FLAC frames, which need their file's
description, are decoded by ``sources.flac``.  Other bit streams need libraries of their own; what is registered here is found by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import resample

Codec = Callable[[Column], Column]
DECODERS: dict[str, Codec] = {"pcm": resample.decode_pcm, "pcm_s16le": resample.decode_pcm}
ENCODERS: dict[str, Codec] = {"pcm": resample.encode_pcm, "pcm_s16le": resample.encode_pcm}


for _kind in resample.PCM:
    if _kind != "s16le":
        DECODERS[f"pcm_{_kind}"] = lambda c, kind=_kind: resample.decode_samples(c, kind)
        ENCODERS[f"pcm_{_kind}"] = lambda c, kind=_kind: resample.encode_samples(c, kind)


def register(name: str, decoder: Codec | None = None, encoder: Codec | None = None) -> None:
    if decoder is not None:
        DECODERS[name] = decoder
    if encoder is not None:
        ENCODERS[name] = encoder


def _of(table: dict[str, Codec], name: str, what: str) -> Codec:
    if name not in table:
        raise ValueError(f"no {what} for {name}")
    return table[name]


def decode(packets: DataFrame, name: str, data: str = "data", samples: str = "samples") -> DataFrame:
    """Packets with their samples; an unknown codec is an error."""
    return packets.withColumn(samples, _of(DECODERS, name, "decoder")(F.col(data))).drop(data)


def encode(frames: DataFrame, name: str, samples: str = "samples", data: str = "data") -> DataFrame:
    """Frames with the data of a packet; an unknown codec is an error."""
    return frames.withColumn(data, _of(ENCODERS, name, "encoder")(F.col(samples))).drop(samples)
