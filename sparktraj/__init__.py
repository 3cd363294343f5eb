"""Trajectory inference on labelled point clouds as DataFrame operators."""
