"""Data cataloguing and documentation as DataFrame-to-DataFrame operators."""
