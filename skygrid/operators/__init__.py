"""Resampling, mosaicking and tiling as DataFrame plans."""
