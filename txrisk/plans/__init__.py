"""Whole jobs: training, scanning, explaining."""
