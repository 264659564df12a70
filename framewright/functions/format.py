"""The packet format's numbers."""

from __future__ import annotations

# Fixed values of the packet format.
MAGIC, VERSION, HEADER_BYTES = "50484443", 1, 8
DELTA_VARINT, RICE, PACKED4, FIXED_WIDTH = 0, 1, 2, 3
STRATEGIES = {"delta_varint": DELTA_VARINT, "rice": RICE, "packed4": PACKED4, "fixed_width": FIXED_WIDTH}
MOST_SAMPLES, BLOCK, RICE_WINDOW, RICE_LIMIT, MOST_ZEROS, MOST_READ_ZEROS = 65535, 32, 16, 48, 255, 1024
