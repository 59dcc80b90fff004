"""Column names and fixed labels of a measurement table.

A measurement table has one row per (image, object, channel). The seven key
columns come first and are strings; every measurement is a double.
"""

from __future__ import annotations

GENOTYPE = "Genotype"
TREATMENT = "Treatment"
IMAGE = "Image File"
CATEGORY = "Category"
OBJECT = "Object"
CHANNEL = "Channel"
OBJECT_ID = "Object ID"
IMAGE_SUBSET = "Image Subset"
TIME = "Time"

KEYS = [GENOTYPE, TREATMENT, IMAGE, CATEGORY, OBJECT, CHANNEL, OBJECT_ID]
OBJECT_KEYS = [GENOTYPE, TREATMENT, IMAGE, CATEGORY, OBJECT, OBJECT_ID]
TRAILING = [IMAGE_SUBSET, TIME]

INTENSITY_SUM = "Intensity Sum"
INTENSITY_MEAN = "Intensity Mean"
INTENSITY_STD = "Intensity StdDev"
VOLUME = "Volume"
AREA = "Area"

SURFACE = "Surface"
NUCLEUS = "Nucleus"
CENTER_OF_MASS = "Nucleus Center of Mass"
MISSING_CHANNEL = "NA"

# Object labels that the integrity report accepts.
ACCEPTED_OBJECTS = [
    "Nucleus",
    "Nucleus Center of Mass",
    "Center of Mass",
    "S2P",
    "Nucleus Center Of Mass",
    "Nucleolus",
    "CC",
    "NanoCC",
]

# Spellings that are unified to CENTER_OF_MASS.
CENTER_OF_MASS_SPELLINGS = [
    "Nucleus_centre_of_mass",
    "Nucleus center of mass",
    "Nucleus Center Of Mass",
]

# A raw column is kept when its name contains one of these, in any case.
RETAINED_TOKENS = [
    "Intensity",
    "Category",
    "Channel",
    "Image",
    "Surpass",
    "Time",
    "ID",
    "Overall",
    "Position",
    "Shortest",
    "Surfaces",
    "Sphericity",
    "Volume",
    "Area",
    "Average",
    "Diameter",
    "Distance",
    "Ellipticity",
    "Spots",
]

# Name patterns of raw files that are not imported. They are regular
# expressions found anywhere in the path, so a dot stands for any character; the blanks
# inside three of the overlap entries belong to them.
SKIPPED_FILES = [
    "Diameter.csv",
    "Diameter_X.csv",
    "Diameter_Y.csv",
    "Diameter_Z.csv",
    "Distance_from_Origin.csv",
    "Distance_to_Image_Border_XY_Img=1.csv",
    "Generation.csv",
    "Intensity_Center_Ch=1_Img=1.csv",
    "Intensity_Center_Ch=2_Img=1.csv",
    "Intensity_Max_Ch=1_Img=1.csv",
    "Intensity_Max_Ch=2_Img=1.csv",
    "Intensity_Median_Ch=1_Img=1.csv",
    "Intensity_Median_Ch=2_Img=1.csv",
    "Intensity_Min_Ch=1_Img=1.csv",
    "Intensity_Min_Ch=2_Img=1.csv",
    "Overlapped_Volume_Ratio_to_Surfaces_Surfaces=CC.csv",
    "Overlapped_Volume_Ratio_to_Surfaces_Surfaces=NanoCC.csv",
    "Overlapped_Volume_Ratio_to_Surfaces_Surfaces=Nucleolus.csv",
    "Overlapped_Volume_Ratio_to_Surfaces_Surfaces=Nucleus.csv",
    "Overlapped_Volume_to_Surfaces_Surfaces=CC.csv",
    "Overlapped_Volume_ to_Surfaces_Surfaces=NanoCC.csv",
    "Overlapped_Volume_ to_Surfaces_Surfaces=Nucleolus.csv",
    "Overlapped_Volume_ to_Surfaces_Surfaces=Nucleus.csv",
    "Position_X.csv",
    "Position_Y.csv",
    "Position_Z.csv",
    "Position.csv",
    "Time.csv",
    "Time_Index.csv",
]
MIN_FILE_BYTES = 100

# Statistics that hold one value per (object, neighbouring surface).
SURFACE_STATISTICS = [
    "Shortest Distance to Surfaces",
    "Overlapped Volume to Surfaces",
    "Overlapped Volume Ratio to Surfaces",
]
SPOT_STATISTIC = "Shortest Distance to Spots"
NEIGHBOUR_COUNTS = [3, 5, 9]
