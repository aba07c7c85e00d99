"""Tables in the shared folder, as the rest of the library writes them."""

from quietlog.store import shared_dir, shuffle_width, written

__all__ = ["shared_dir", "shuffle_width", "written"]
