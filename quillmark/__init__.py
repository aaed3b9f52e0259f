"""Part of quillmark, account-level text analytics on Spark."""
