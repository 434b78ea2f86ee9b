"""Drawing on the executors with numpy: TrueType outlines, warps, blur, composition, PNG."""
