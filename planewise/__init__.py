"""Planewise: numeric tensors and model checkpoints as Spark tables, analysed and coded losslessly.

The functions here work on single buffers; ``planewise.operators`` has their DataFrame forms.
"""

from planewise.functions.checkpoint import (
    CheckpointReader,
    compress_checkpoint,
    compress_file,
    decompress_checkpoint,
    decompress_file,
    load_file,
    model_delta_compress,
    model_delta_compress_file,
    model_delta_decompress,
    model_delta_decompress_file,
    peek,
    save_file,
)
from planewise.functions.codec import (
    FrameError,
    chunked_compress,
    compress,
    decompress,
    decompress_array,
    delta_compress,
    delta_decompress,
    info,
    is_adaptive,
    is_kind,
    turbo_compress,
)

#: An array goes through the same function as bytes do.
compress_array = compress

__all__ = [
    "CheckpointReader", "FrameError", "chunked_compress", "compress", "compress_array", "compress_checkpoint", "compress_file", "decompress", "decompress_array",
    "decompress_checkpoint", "decompress_file", "delta_compress", "delta_decompress", "info", "is_adaptive", "is_kind", "load_file", "model_delta_compress",
    "model_delta_compress_file", "model_delta_decompress", "model_delta_decompress_file", "peek", "save_file", "turbo_compress",
]
