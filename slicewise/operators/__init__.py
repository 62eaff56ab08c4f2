"""Row-level work as DataFrame plans: subsetting, integrity, masking, loading."""
