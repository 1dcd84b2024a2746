"""Row-level operators: profiling, quality, preparation, splits, calibration, diagnosis, events, recommendation."""
