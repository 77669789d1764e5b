from labelvec.functions.vectors import (
    argmax,
    clip_unit,
    combined_line,
    dropout_mask,
    flatten_image,
    from_csv_line,
    histogram_bucket,
    log_bucket,
    log_bucket_value,
    normalize,
    one_hot,
    prediction_line,
    quantize,
    reshape_image,
    split_combined_line,
    to_csv_line,
    uint8,
)
from labelvec.functions.losses import clipped_cross_entropy, logit_cross_entropy, softmax

__all__ = [
    "argmax",
    "clip_unit",
    "clipped_cross_entropy",
    "combined_line",
    "dropout_mask",
    "flatten_image",
    "from_csv_line",
    "histogram_bucket",
    "log_bucket",
    "log_bucket_value",
    "logit_cross_entropy",
    "normalize",
    "one_hot",
    "prediction_line",
    "quantize",
    "reshape_image",
    "softmax",
    "split_combined_line",
    "to_csv_line",
    "uint8",
]
