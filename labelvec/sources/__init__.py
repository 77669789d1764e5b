from labelvec.sources.columnar import (
    CHUNK_BITS,
    read_pickle_pair,
    read_samples,
    write_pickle_pair,
    write_samples,
)
from labelvec.sources.idx import read_idx_images, read_idx_labels, read_idx_pair
from labelvec.sources.text import (
    read_combined,
    read_combined_numbered,
    read_csv_pair,
    read_prediction_lines,
    read_vectors,
    write_combined,
    write_csv_pair,
    write_predictions,
)
from labelvec.sources.tfrecord import read_tfrecord, write_tfrecord

__all__ = [
    "CHUNK_BITS",
    "read_combined",
    "read_combined_numbered",
    "read_csv_pair",
    "read_idx_images",
    "read_idx_labels",
    "read_idx_pair",
    "read_pickle_pair",
    "read_prediction_lines",
    "read_samples",
    "read_tfrecord",
    "read_vectors",
    "write_combined",
    "write_csv_pair",
    "write_pickle_pair",
    "write_predictions",
    "write_samples",
    "write_tfrecord",
]
