from lever.streaming.buckets import bucket_stream, run_to_table

__all__ = ["bucket_stream", "run_to_table"]
