"""Structured Streaming: live loss bookkeeping while a run is training."""

from lethe.streaming.step_log import epoch_loss_stream, start_epoch_loss_query  # noqa: F401
