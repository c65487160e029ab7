from fidelis.functions.columns import (  # noqa: F401
    clean,
    clean_frame,
    clip,
    hash_normal,
    hash_uniform,
    ks_p_value,
    log1p_amount,
    quality_band,
    seconds_to_hours,
    threshold_label,
)
