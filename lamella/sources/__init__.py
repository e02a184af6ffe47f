"""What is stored: sorted runs, the manifest and the binary log."""
