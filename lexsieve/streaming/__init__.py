from lexsieve.streaming.appending import append_stream

__all__ = ["append_stream"]
