"""Part of kbforge; see README.md."""
